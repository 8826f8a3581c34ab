import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, brute_groups, brute_hits, prose

import corpus_pipeline
from pixelloom.llm import pii, toxicity
from pixelloom.llm.queries import pii_key, tokenizer_path

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_run(spark):
    packed = corpus_pipeline.run(spark, DATA)
    total = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r["sum(length)"] <= 4096 for r in total)
    have = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert have <= {r[0] for r in duckdb.sql(f"select doc_id from '{DATA}/documents.parquet'").fetchall()}


def test_clean_documents_stay(spark):
    """Without toxic words, copies, benchmark passages and personal data a document passes all stages unchanged."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, DATA).cache()
    pairs = docs.join(after.withColumnRenamed("text", "new"), ["doc_id"]).filter("not text rlike '[0-9@]'")
    assert pairs.filter("text <> new").count() == 0 and pairs.count() > 100


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with all that the stages have to decide on."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "lorem ipsum dolor amet elit sed".split() for b in "ta ke mo ri su na".split()]
    texts = {i: prose(rng, 40, vocabulary) for i in range(60)}
    for i in range(0, 60, 4):
        texts[i] += " you worthless pathetic idiot."
    texts[5] = texts[1] + " more"
    texts[6] = texts[1]
    passage = prose(rng, 20, vocabulary)
    texts[7] = f"{passage} and {prose(rng, 30, vocabulary)}"
    texts[9] = f"Dear Mr John Smith, write to john@smith.org or +1 415 555 0000. {prose(rng, 20, vocabulary)}"
    texts[10] = prose(rng, 30_000, vocabulary)
    texts[11] = "a <|endoftext|> b"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n ", None, "s", 3), (None, texts[13] + " x", "en", "s", None), (14, texts[14], "en", "s", 1), (14, texts[14], "en", "s", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_stages_against_brute_force(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    learn = sorted((i, t) for i, t, *_ in set(rows) if i is not None and i < 60 and zlib.crc32(str(i).encode()) % 5)
    toxic = np.array([i % 4 == 0 for i, _ in learn])
    model = toxicity.fit([t for _, t in learn], toxic, np.ones(len(learn)))
    found = stages["toxicity"](spark, docs, at)
    assert ids(found) == Counter(i for i, t, *_ in rows if model.score([t or ""])[0] < 0.5) and not any(i is not None and i < 60 and i % 4 == 0 for i in ids(found))
    found = stages["near_dedup"](spark, docs, at)
    groups = brute_groups([r[:2] for r in rows], k=5)
    assert ids(found) == Counter({i for (i, _, least) in groups if i == least or (i is None and least is None)})
    found = stages["decontamination"](spark, docs, at)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    bad = {i for i, t, *_ in rows if (x := brute_hits(t, items))[1] and 20 * x[1] >= x[0]}
    assert bad == {7} and ids(found) == Counter(r[0] for r in rows if r[0] not in bad)
    found = {r.doc_id: r for r in stages["pii"](spark, docs, at).collect()}
    mentions = pii.pseudonymise(docs, pii_key(spark), mentions_col="m").filter("doc_id = 9").first().m
    want = next(t for i, t, *_ in rows if i == 9)
    for m in mentions:
        want = want.replace(m.entity, m.surrogate)
    assert [m.kind for m in mentions] == ["name", "email", "phone"] and found[9].text == want and found[9].n_chars == len(want)
    assert all(found[i].text == t for i, t, *_ in rows if i != 9)
    packed = stages["packing"](spark, docs, at).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 4096
    sizes = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in rows}
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == Counter({i: n * sum(r[0] == i for r in rows) for i, n in sizes.items()})
    whole, rest = 0, []
    for r in rows:  # one after the other, the longest first, into the smallest gap
        whole += sizes[r[0]] // 4096
        rest.append(sizes[r[0]] % 4096)
    gaps = []
    for n in sorted(filter(None, rest), reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(4096 - n)
    assert len(held) <= whole + len(gaps)


def test_extra_columns_and_empty_tables(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").drop("n_chars").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns and out.filter("toxicity <> 'old' or host <> 'h'").isEmpty())
        assert stage(spark, empty, at).count() == 0
