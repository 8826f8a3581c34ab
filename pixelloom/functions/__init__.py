"""Scalar functions, as SQL text or columns, for use outside the operators."""

from ..operators.codec_steps import gif_row, paeth, read_be, read_le
from ..operators.pixel import dpi_to_ppm, ppm_to_dpi, sample_depth, srgb_decode
from ..sources.probe import format_of

__all__ = ["dpi_to_ppm", "format_of", "gif_row", "paeth", "ppm_to_dpi", "read_be", "read_le", "sample_depth", "srgb_decode"]
