"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more key characters with a digit in it and what follows it after dots, or whatever of 6 or more characters stands after a
word of ``CUES`` and ``=`` or ``:``, with or without digits. The forest looks at its length and
character transitions, how much of it dictionary words cover, whether it stands in a path or url, and
at its neighbours (the word before, ``=`` or ``:``, quotes). It is trained from labelled findings, a
DataFrame ``before, candidate, after, is_secret``; ``example_findings`` makes one by rule, from public
formats of keys and of what is mistaken for them. The forest is fitted on at most ``max_findings`` of them.

Everything on the way is built-in functions and the DataFrame API of Spark's own forest.

Defined cases: null and empty texts have no candidates; where two candidates overlap the first counts; rows are scanned one by
one, so rows that repeat give the same result each; very long texts are scanned whole, their candidates come one a row; an empty
table gives no rows; without labelled findings every candidate counts as a secret; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MAX_FINDINGS = 20_000
#: Words that announce a secret, and common words and word parts of identifiers.
CUES = "token key secret password passwd pwd api apikey auth bearer credential private access signature sig salt hmac"
LONG_RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z0-9+/_\-]{16})[A-Za-z+/_\-]*[0-9][A-Za-z0-9+/_\-]*(?:\.[A-Za-z0-9+/_\-]{6,}){0,8}"
AFTER_CUE = r"(?<=(?i:" + "|".join(sorted(CUES.split(), key=lambda w: (-len(w), w))) + r")[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'<>,;=:]{6,}"
CANDIDATE = AFTER_CUE + "|" + LONG_RUN
#: No candidate is in a text without this.
HINT = r"[0-9]|(?i:" + "|".join(CUES.split()) + r")[\"']?\s{0,2}[=:]"
DICTIONARY = (
    "the and ing tion ment able with from that this for not are was have one all can had her were when your said there use each which their "
    "time will way about many then them write would like into more two has look see number could people first part file path name index data table "
    "page image static style script version release build test example sample default user group order item list page node main home public local "
    "linux windows android server client http https www html json data-set config module package import export lorem ipsum dolor"
)
FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "hex", "distinct", "runs", "words", "path", "equals", "quoted", "cue", "dashes", "tail"]


def features(before: Column, candidate: Column, after: Column) -> list[Column]:
    """The forest's inputs, named as in FEATURES."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(candidate, f"[^{pattern}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A"), "[^9aA]", "-")
    lowered = F.lower(candidate)
    uncovered = F.length(F.regexp_replace(lowered, "|".join(sorted({w for w in DICTIONARY.split() if len(w) > 2}, key=lambda w: (-len(w), w))), ""))
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    values = {
        "length": n, "digits": share("0-9"), "uppers": share("A-Z"), "lowers": share("a-z"), "others": 1 - share("A-Za-z0-9"),
        "transitions": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "hex": share("0-9a-fA-F"), "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "runs": 1 - F.length(F.regexp_replace(candidate, r"(.)\1+", "$1")) / n,
        "words": 1 - uncovered / n,
        "path": (candidate.contains("/") | before.rlike(r"[/\\.]$") | after.rlike(r"^[/\\.][A-Za-z]")).cast("double"),
        "equals": before.rlike(r"[=:]\s*[\"']?$").cast("double"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "cue": word.isin(CUES.split()).cast("double"), "dashes": share(r"\-_"),
        "tail": F.length(F.regexp_extract(candidate, r"([0-9]*)$", 1)) / n,
    }
    return [F.coalesce(values[k], F.lit(0.0)).alias(k) for k in FEATURES]


def example_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``n`` labelled findings by rule, and half as many short ones: keys in the public shapes, and look-alikes, each after several kinds of words."""
    h = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id")), 256), 1, size)
    dec = lambda salt, size: F.substring(F.translate(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id")), 256), "abcdef", "724906"), 1, size)
    b64 = lambda salt, size: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id")), 512))), "=+/", "x7Q"), 1, size)
    pick = lambda k, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(options))) + 1).cast("int"))
    secret = [h("a", 40), h("b", 32), h("c", 64), b64("d", 40), F.concat(F.lit("AKIA"), F.upper(h("e", 16))), F.concat(F.lit("ghp_"), b64("f", 36)), b64("g", 24), F.upper(h("h", 40))]
    names = ["tiger", "summer", "dragon", "coffee", "monkey", "winter", "purple"]
    short = [F.concat(pick(11, names), dec("l", 2), F.lit("!")), b64("m", 8), F.concat(b64("n", 5), F.lit("$"), b64("o", 4)), F.concat(F.initcap(pick(12, names)), F.lit("#"), dec("p", 3)), b64("q", 12)]
    words = ["version", "release", "image", "index", "page", "table"]
    other = [
        dec("a", 16), dec("b", 20), F.concat(h("c", 8), F.lit("-"), h("d", 4), F.lit("-"), h("e", 4), F.lit("-"), h("f", 4), F.lit("-"), h("g", 12)),
        F.concat(pick(1, words), F.lit("_"), pick(2, words), F.lit("_"), dec("h", 4)), F.concat(F.lit("static/"), pick(3, words), F.lit("/"), dec("i", 8)),
        F.concat(F.lit("2024-"), dec("j", 2), F.lit("-"), dec("k", 2), F.lit("-"), pick(4, words)), F.concat(F.lit("example_key_"), F.lit("0000000000")), F.repeat(pick(5, ["x1", "0", "12"]), 12),
    ]
    idle = [pick(13, ["required", "optional", "string", "example", "default", "unknown", "version", "following"]), F.concat(F.lit("your-"), pick(14, ["token", "key", "password"]), F.lit("-here")), F.lit("<redacted>"), F.lit("********"), F.concat(pick(15, words), F.lit("."), pick(16, words)), F.concat(F.lit("${"), F.upper(pick(17, words)), F.lit("}"))]
    rows = spark.range(n).withColumn("is_secret", F.col("id") % 2 == 0)
    nth = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(8))
    choose = lambda options: F.coalesce(*[F.when(nth == i, c) for i, c in enumerate(options)])
    plain = ["the order of ", "see page ", "and then ", "of 12 from ", "said that "]
    marked = ['token = "', 'api_key: "', "secret=", "password: ", 'Authorization: Bearer ', 'private key "']
    odd = ["/usr/share/", "https://www.example.com/", "id = ", "commit ", 'number: "', 'sha256: "']
    # A tenth of either kind stands where the other usually does.
    swapped = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) == 0
    cue = F.when(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2)) == 0, pick(6, plain)).otherwise(pick(7, odd))
    before = F.when(F.col("is_secret") != swapped, pick(10, marked)).otherwise(cue)
    after = F.when(before.endswith('"'), '" ').otherwise(" and ")
    long_ones = rows.select(before.alias("before"), F.when(F.col("is_secret"), choose(secret)).otherwise(choose(other)).alias("candidate"), after.alias("after"), "is_secret")
    # Short ones stand after a cue, whatever they are.
    nth_of = lambda options: F.coalesce(*[F.when(F.pmod(F.xxhash64("id", F.lit(18)), F.lit(len(options))) == i, c) for i, c in enumerate(options)])
    cued = pick(19, marked)
    end = F.when(cued.endswith('"'), '" ').otherwise(" and ")
    short_ones = rows.filter("id % 4 < 2").select(cued.alias("before"), F.when(F.col("is_secret"), nth_of(short)).otherwise(nth_of(idle)).alias("candidate"), end.alias("after"), "is_secret")
    return long_ones.unionByName(short_ones)


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 20, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel | None:
    """The forest of labelled findings; None if there are none, or of one kind only."""
    some = findings.filter("candidate is not null and is_secret is not null").orderBy(F.xxhash64("before", "candidate", "after"), "candidate").limit(max_findings)
    rows = cut(some.select(F.col("is_secret").cast("double").alias("label"), *features(F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit("")))))
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return model.copy()  # without the training summary, whose session can't be sent to tasks once it has observed a query


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate, and one without for rows that have none: ``id, row, at, before, candidate, after``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = own.withColumn("found", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    pieces = F.when(F.size("found") > 0, F.split("text", CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    context = found.withColumn("pieces", pieces).select(
        "id", "row", F.transform("found", lambda c, i: F.struct(
            i.alias("at"), F.right(F.element_at("pieces", i + 1), F.lit(40)).alias("before"), c.alias("candidate"), F.left(F.element_at("pieces", i + 2), F.lit(10)).alias("after"))).alias("all")
    )
    return context.select("id", "row", F.explode_outer("all").alias("x")).select("id", "row", "x.at", "x.before", "x.candidate", "x.after")


def judged(docs: DataFrame, findings: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: ``id, n_candidates, n_secrets, found``, an array of ``(at, candidate)`` in order of place."""
    model = train(findings)
    rows = candidates(docs, id_col, text_col)
    if model is None:
        scored = rows.withColumn("score", F.lit(1.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.select("id", "row", "at", "candidate", *features(F.col("before"), F.coalesce("candidate", F.lit("")), F.col("after"))).na.fill(0.0, FEATURES))
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    secret = F.col("candidate").isNotNull() & (F.col("score") >= threshold)
    return scored.groupBy("row").agg(
        F.first("id").alias("id"), F.count("candidate").alias("n_candidates"), F.count(F.when(secret, 1)).alias("n_secrets"),
        F.array_sort(F.collect_list(F.when(secret, F.struct("at", "candidate")))).alias("found"),
    )


def scan(docs: DataFrame, findings: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_candidates, n_secrets, secrets``, the array in order of place."""
    return judged(docs, findings, threshold, id_col, text_col).select("id", "n_candidates", "n_secrets", F.col("found.candidate").alias("secrets"))


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[secret]", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text_col`` masked where it was found; other columns pass through."""
    own = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = own.select(F.col("__row"), F.col(text_col))
    marks = judged(rows, findings, threshold, "__row", text_col).filter("n_secrets > 0").select(F.col("id").alias("__of"), F.col("found.at").alias("__at"))
    joined = own.join(marks, F.col("__row") == F.col("__of"), "left")
    shown = F.transform(F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)), lambda c, i: F.when(F.array_contains("__at", i), mask).otherwise(c))
    # What lies between the candidates and the candidates, one after the other.
    pairs = F.zip_with(F.split(text_col, CANDIDATE, -1), F.concat(shown, F.array(F.lit(""))), lambda between, own: F.concat(between, own))
    masked = F.array_join(pairs, "")
    return joined.withColumn(text_col, F.when(F.col("__at").isNull(), F.col(text_col)).otherwise(masked)).select(*[F.col(c) for c in docs.columns])
