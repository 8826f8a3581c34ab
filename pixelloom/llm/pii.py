"""Personal data: detected entities get keyed surrogates of their own kind.

Found by pattern: emails; names after a title (of address, or Dr, Prof, Rev), with hyphens, apostrophes and capitals inside, and the same given and family name without a title in the same text;
phone numbers of three, three and four digits with a separator before the last four, and any of 8 to 15 digits after a
``+``; card numbers of 13 to 19 digits in the usual groups; IPv4 and IPv6 addresses; social security numbers; IBANs.
Not found: numbers of national formats without a ``+`` other than those, and names never seen with a title.

An entity's normal form has one surrogate in the whole corpus, so mentions keep referring to the same one. Separators,
case and a title's spelling are left out of it; a phone number of ten digits without a country code is one of ``+1``.
Names are two entities, a given name (by gender of the title, and script) and a family name, and emails are two, the
domain without its top level and the local part in it; so Mr Smith and Mr John Smith keep one family name, and emails of one
domain stay on one domain. Each mention is printed in its own format: grouping, case, digits for digits, letters of the same
script for letters. Card numbers keep their first digit and whether the Luhn check holds, phone numbers their country
code, emails their top-level domain, names their title.

Surrogates are drawn from a hash of the caller's key, the normal form and a number of attempts. Two entities with one
surrogate, or a surrogate that the corpus has as a real entity (for given names: as its own), are collisions: all
but the smallest of the entities try again, until none is left. Names get longer with each attempt, everything else from
the ``PATIENCE``-th on, so that no space of surrogates is ever full. Entities are aggregated before they are shuffled; rows
without any are neither shuffled nor joined, and a very common entity meets its surrogate in ``SALTS`` parts.

Everything is built-in functions. Defined cases: null texts stay null and empty ones empty; texts without
entities are not touched; where entities overlap the first counts, of those at one place the first in ``PATTERNS``;
very long texts are scanned whole (patterns look back and ahead by bounded amounts); rows that repeat give equal results; an
empty table stays empty; all columns pass through, whatever their names, and ``n_chars``-like counts are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

#: Attempts before surrogates of fixed length get longer, and parts that a very common entity is joined in.
PATIENCE, SALTS = 8, 16
# Titles by gender, and given names by gender and script to draw from.
FEMALE = "Mrs Ms Miss Frau Mme Mlle Madame Sra Señora Signora Г-жа"
MALE = "Mr Herr M Monsieur Sr Señor Signor Г-н"
EITHER = "Dr Prof Professor Rev"
GIVEN = {
    ("f", "latin"): "Anna Maria Clara Elena Julia Laura Nina Paula Rosa Sara Vera Emma Ida Lena Marta Olga",
    ("m", "latin"): "Adam Boris David Emil Felix Hugo Ivan Jonas Karl Leo Max Noel Oskar Paul Theo Viktor",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Полина Софья Тамара Ульяна Юлия Алина Майя",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Тимур Юрий",
}
# After a title of either gender a given name may be any.
GIVEN |= {("e", x): f"{GIVEN['f', x]} {GIVEN['m', x]}" for x in ("latin", "cyrillic")}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro",
    "cyrillic": "ба бе би бо да де ди до фа фе га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро",
}
# Country calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TITLE = r"(?<!\p{L})(?:" + "|".join(sorted(f"{FEMALE} {MALE} {EITHER}".split(), key=lambda t: (-len(t), t))) + r")\.?"
#: A part of a name: Müller, McDonald, O'Brien, Smith-Jones.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’\-](?=\p{L}))+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ \-]?){3}[0-9]{4}(?:[ \-]?[0-9]{3})?|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][ \-]?[0-9]{6}[ \-]?[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9](?:[ .\-()]{0,2}[0-9]){7,14}(?![0-9])",
    "ip": r"(?<![0-9.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?![0-9])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])",
    "name": TITLE + f" {WORD}(?: {WORD})?",
}
#: Any entity; none is in a text without one of these characters or a title, which is tested first.
ANY = "|".join(PATTERNS.values())
HINT = r"[0-9@]|" + TITLE + r" \p{Lu}"
NAME = r"^(\S+) (?:(\S+) )?(\S+)$"


def has_entities(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))


def kind(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("other"))


def bare(entity: Column) -> Column:
    return F.upper(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))


def script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsLatin}"), "latin").otherwise("other")


def parts(kind: Column, entity: Column) -> Column:
    """``(slot, kind, scope, form)``: what a mention is made of; surrogates differ within a kind and scope."""
    digits = bare(entity)
    national = F.when((kind == "phone") & ~entity.startswith("+") & (F.length(digits) == 10), F.concat(F.lit("1"), digits)).otherwise(digits)
    form = F.when(kind.isin("card", "ssn", "phone", "iban"), national).otherwise(F.lower(entity))
    one = lambda slot, kind, scope, form: F.struct(F.lit(slot).alias("slot"), kind.alias("kind"), scope.alias("scope"), form.alias("form"))
    title, given, family = (F.regexp_extract(entity, NAME, i) for i in (1, 2, 3))
    plain = F.regexp_replace(title, r"\.$", "")
    gender = F.when(plain.isin(FEMALE.split()), "f").when(plain.isin(EITHER.split()), "e").otherwise("m")
    first = one(1, F.lit("given"), F.concat(gender, F.lit(" "), script(given)), F.lower(given))
    last = one(2, F.lit("family"), script(family), F.lower(family))
    names = F.when(given == "", F.array(last)).otherwise(F.array(first, last))
    lowered = F.lower(entity)
    at = F.regexp_extract(lowered, r"@(.*)$", 1)
    local = one(1, F.lit("local"), at, F.regexp_extract(lowered, r"^(.*)@", 1))
    domain = one(2, F.lit("domain"), F.lit(""), F.regexp_extract(at, r"^(.*)\.[^.]+$", 1))
    return F.when(kind == "name", names).when(kind == "email", F.array(local, domain)).otherwise(F.array(one(1, kind, F.lit(""), form)))


def seed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def number(seed: Column, i: Column | int, below: int) -> Column:
    """The ``i``-th number of a seed, 0 to ``below - 1``."""
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(below)).cast("int")


def drawn(seed: Column, form: Column, keep: Column) -> Column:
    """``form`` with every letter and digit from position ``keep`` on replaced by one of its own kind and script."""

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        ranges = [(48, 10), (97, 26), (65, 26), (0x430, 32), (0x410, 32), (0x3B1, 17), (0x391, 17)]
        other = F.when(c.rlike(r"^\p{Ll}$"), F.char(number(seed, i, 26) + 97)).when(c.rlike(r"^\p{L}$"), F.char(number(seed, i, 26) + 65)).when(c.rlike(r"^\p{N}$"), number(seed, i, 10).cast("string")).otherwise(c)
        found = other
        for first, n in reversed(ranges):
            letter = F.decode(F.unhex(F.lpad(F.hex(number(seed, i, n) + first), 4, "0")), "UTF-16BE")
            found = F.when((code >= first) & (code < first + n), letter).otherwise(found)
        return F.when(i < keep, c).otherwise(found)

    return F.array_join(F.transform(F.filter(F.split(form, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    return F.aggregate(
        F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: (a + x).cast("int"),
    )


def drawn_from(seed: Column, names: str, n: Column, by: str) -> Column:
    """``n`` of the names, one after the other."""
    choices = names.split()
    one = lambda i: F.element_at(F.array(*map(F.lit, choices)), number(seed, i, len(choices)) + 1)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), by)


def surrogate(kind: Column, scope: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a form at that attempt; names are capitalised."""
    s = seed(key, kind, scope, form, attempt)
    zero = F.lit(0)
    more = F.greatest(attempt - PATIENCE, zero)
    longer = F.concat(form, F.repeat(F.when(kind.isin("local", "domain"), "a").otherwise("0"), more))
    body = F.left(drawn(s, form, F.lit(1)), F.length(form) - 1)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    last = F.when(luhn_sum(form) % 10 == 0, check).otherwise((check + 1 + number(s, 99, 9)) % 10)
    card = F.concat(body, last.cast("string"), F.repeat(F.lit("0"), more))
    ip = F.array_join(F.transform(F.sequence(zero, F.lit(3)), lambda i: (number(s, i, 254) + 1).cast("string")), ".")
    ip = F.concat(ip, F.when(more > 0, F.concat(F.lit("-"), more.cast("string"))).otherwise(""))
    ip6 = F.array_join(F.transform(F.filter(F.split(longer, ""), lambda c: c != ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(number(s, i, 16))))), "")
    # Scripts without names to draw from: other letters of the same script.
    other = F.initcap(drawn(s, F.concat(form, F.repeat(F.right(form, F.lit(1)), attempt)), zero))
    given = F.coalesce(*[F.when(scope == f"{g} {x}", drawn_from(s, names, attempt + 1, "-")) for (g, x), names in GIVEN.items()], other)
    family = F.coalesce(*[F.when(scope == x, F.initcap(drawn_from(s, names, attempt + 4, ""))) for x, names in SYLLABLES.items()], other)
    code = F.when(form.rlike("^[17]"), 1).when(F.left(form, F.lit(2)).isin(TWO_DIGITS.split()), 2).otherwise(3)
    keep = F.when(kind == "phone", code).when(kind == "iban", 2).otherwise(zero)
    return F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "given", given).when(kind == "family", family).otherwise(drawn(s, longer, keep))


def printed(kind: Column, entity: Column, one: Column, two: Column) -> Column:
    """A mention with the surrogates ``one`` and ``two`` of its parts, in the format of ``entity``."""
    # Letters and digits of the surrogate, one after the other, in the places of the mention's; a longer one ends behind them.
    own = F.length(bare(entity))
    short = (kind == "phone") & ~entity.startswith("+") & (own == 10)
    form = F.when(short, F.substring(one, F.lit(2), F.length(one))).otherwise(one)
    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    grouped = F.aggregate(
        chars, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["out"], F.substring(form, acc["k"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(form, acc["k"] + 1, F.length(form))),
    )
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    cased = lambda x: F.when(upper, F.upper(x)).otherwise(x)
    email = F.concat(one, F.lit("@"), two, F.regexp_extract(F.lower(entity), r"(\.[^.]+)$", 1))
    name = F.concat_ws(" ", F.regexp_extract(entity, NAME, 1), F.when(F.regexp_extract(entity, NAME, 2) != "", one), two)
    return F.when(kind.isin("card", "ssn", "phone", "iban"), grouped).when(kind == "name", name).when(kind == "email", cased(email)).otherwise(cased(one))


def mentions_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, at, kind, entity`` of the distinct rows that have entities, in order of place."""
    text = F.col(text_col)
    own = docs.filter(has_entities(text)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"))
    return own.distinct().select("id", "text_hash", F.posexplode("found").alias("at", "entity")).withColumn("kind", kind(F.col("entity")))


def assign(forms: DataFrame, key: str) -> DataFrame:
    """``kind, scope, form, surrogate`` of distinct ``(kind, scope, form)``; in a kind and scope no surrogate twice or equal to a form."""
    done: DataFrame | None = None
    group = ["kind", "scope", "plain"]
    real = forms.filter("kind <> 'given'").select("kind", "scope", F.lower("form").alias("plain"), F.lit(True).alias("taken")).distinct()
    pending = forms.withColumn("attempt", F.lit(0))
    while True:
        tried = pending.withColumn("surrogate", surrogate(*map(F.col, ("kind", "scope", "form", "attempt")), key)).withColumn("plain", F.lower("surrogate"))
        tried = tried.join(real, group, "left").withColumn("used", F.lit(None).cast("boolean"))
        if done is not None:
            used = done.select("kind", "scope", F.lower("surrogate").alias("plain"), F.lit(True).alias("held"))
            tried = tried.drop("used").join(used.withColumnRenamed("held", "used"), group, "left")
        free = "taken is null and used is null and plain <> form"
        first = tried.filter(free).groupBy(*group).agg(F.min("form").alias("winner"))
        tried = cut(tried.join(first, group, "left").withColumn("won", F.expr(f"{free} and coalesce(form = winner, false)")))
        won = tried.filter("won").select("kind", "scope", "form", "surrogate")
        done = won if done is None else done.unionByName(won)
        pending = tried.filter("not won").select("kind", "scope", "form", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, mentions, names`` of rows with entities.

    ``mentions`` are ``(at, kind, entity, surrogate)`` in order of place, ``names`` ``(pattern, surrogate)`` of given
    and family names without their titles.
    """
    mention = cut(mentions_of(docs, id_col, text_col))
    part = mention.withColumn("p", F.explode(parts(F.col("kind"), F.col("entity")))).select("id", "text_hash", "at", F.col("kind").alias("of"), "entity", "p.slot", "p.kind", "p.scope", "p.form")
    table = assign(part.select("kind", "scope", "form").distinct(), key)
    joined = salted_join(part, table, ["kind", "scope", "form"], SALTS)
    pick = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("surrogate")))
    whole = joined.groupBy("id", "text_hash", "at").agg(F.first("of").alias("kind"), F.first("entity").alias("entity"), pick(1).alias("one"), pick(2).alias("two"))
    whole = whole.withColumn("surrogate", printed(*map(F.col, ("kind", "entity", "one", "two"))))
    full = (F.col("kind") == "name") & F.col("one").isNotNull()
    name = F.struct(F.concat(F.lit(r"(?<!\p{L})"), F.regexp_extract("entity", r"^\S+ (.*)$", 1), F.lit(r"(?!\p{L})")).alias("pattern"), F.concat_ws(" ", "one", "two").alias("surrogate"))
    return whole.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "entity", "surrogate"))).alias("mentions"), F.array_sort(F.collect_set(F.when(full, name))).alias("names")
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", mentions_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and if named a column of the mentions.

    ``key`` is the caller's secret: who has it can tell which surrogate an entity gets.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col(text_col)
    none = F.array().cast("array<struct<at:int,kind:string,entity:string,surrogate:string>>")
    columns = [F.col(c) for c in docs.columns]
    extra = lambda found: [found.alias(mentions_col)] if mentions_col else []
    untouched = docs.filter(~has_entities(text)).select(*columns, *extra(none))
    marks = surrogates(docs, key, id_col, text_col).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("mentions").alias("__mentions"), F.col("names").alias("__names"))
    # Rows that repeat meet one row of marks; the text is looked up by id and hash.
    touched = docs.filter(has_entities(text)).withColumn("__own", F.xxhash64(text)).join(marks, docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    between = lambda piece: F.aggregate("__names", piece, lambda t, n: F.regexp_replace(t, n["pattern"], n["surrogate"]))
    pieces = F.transform(F.split(text, ANY, -1), between)
    rebuilt = F.element_at(F.transform(F.array(pieces), lambda p: F.concat(F.array_join(F.transform("__mentions", lambda m, i: F.concat(F.element_at(p, i + 1), m["surrogate"])), ""), F.element_at(p, -1))), 1)
    return untouched.unionByName(touched.withColumn(text_col, rebuilt).select(*columns, *extra(F.col("__mentions"))))
