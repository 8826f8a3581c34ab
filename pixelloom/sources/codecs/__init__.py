"""Codecs of raster files, as functions of bytes; every data error is an ImageError with a result code."""

from __future__ import annotations

import struct
import zlib

from ...model import ImageError, Limits
from . import bmp, gif, ico, jpeg, png, tiff, webp
from .base import Document, Item, Raster, oriented

#: Name to module; each has ``matches(content)``, ``load(content, limits)`` and, where it writes, ``save(document, **options)``.
REGISTRY = {"png": png, "jpeg": jpeg, "gif": gif, "bmp": bmp, "tiff": tiff, "ico": ico, "webp": webp}


def register(name: str, module: object) -> None:
    """Add a codec; a name that is taken is refused."""
    if name in REGISTRY:
        raise ImageError("INVALID", f"{name} is registered already")
    REGISTRY[name] = module


def name_of(content: bytes) -> str | None:
    """The first registered codec that recognises the bytes."""
    return next((n for n, m in REGISTRY.items() if m.matches(content)), None)


def load(content: bytes, limits: Limits = Limits()) -> Document:
    """Decode a file; the Exif orientation is undone in the pixels."""
    name = name_of(content)
    if name is None:
        raise ImageError("FORMAT", "no codec knows these bytes")
    try:
        doc = REGISTRY[name].load(content, limits)
    except ImageError:
        raise
    except (struct.error, zlib.error, IndexError, ValueError, KeyError, TypeError, OverflowError, ArithmeticError, EOFError, StopIteration) as e:
        raise ImageError("CORRUPT", f"{type(e).__name__}: {e}") from e
    for item in doc.items:
        item.raster = oriented(item.raster, doc.orientation)
    return doc


def save(doc: Document, name: str, **options) -> bytes:
    if name not in REGISTRY or not hasattr(REGISTRY[name], "save"):
        raise ImageError("UNSUPPORTED", f"no writer for {name}")
    return REGISTRY[name].save(doc, **options)


__all__ = ["REGISTRY", "Document", "Item", "Raster", "load", "name_of", "register", "save"]
