"""The pipeline, stage by stage against brute force, on a table with nulls, copies, empty texts and clashing columns."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regraph.llm import near_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, keep string, _id long, _parts string, src string, row string, rep long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def rows():
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(some(r.randrange(20, 200))) for _ in range(30)]
    texts += [" ".join([*some(30), "awful", "scum", *some(20)]) for _ in range(12)]
    base = some(150)
    texts += [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(10, 140, 13)]
    texts += [texts[0], "  " + texts[0].replace(" ", "\n"), texts[1], "", None, "  ", "one two", " ".join(some(5000)), "w1 " * 60]
    out = [(i + 1, t, None if i % 9 == 4 else "en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t), i, "k", i, "p", "x", "y", None) for i, t in enumerate(texts)]
    return [*out, out[3], (None, *out[5][1:])]


def labels():
    return [(d, int("scum" in (t or "")), 1.0) for d, t, *_ in rows() if d is not None]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and what each stage returns."""
    sf = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, toxic int, quality double").write.parquet(f"{sf}/labels.parquet")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{sf}/out/{name}")
        out.append(spark.read.parquet(f"{sf}/out/{name}"))
    return sf, out


def kept(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_but_the_last_stage_keep_the_columns(stages):
    _, out = stages
    assert all(df.columns == out[0].columns for df in out[1:-1])


def test_toxic_documents_go(stages):
    sf, (docs, clean, *_) = stages
    model = toxicity.train(docs, docs.sparkSession.read.parquet(f"{sf}/labels.parquet"))
    got = docs.collect()
    row, slot, value = toxicity.features(pa.array([r.text for r in got]))
    logit = model.logits(row, slot, value, len(got))
    assert kept(clean) == Counter(tuple(r) for r, z in zip(got, logit) if z < 0)
    assert not clean.where(F.col("text").contains("scum")).count() and clean.count() > 30


def test_one_of_equal_texts_stays(stages):
    _, (_, clean, once, *_) = stages
    norm = lambda r: SPACES.sub(" ", r.text or "")
    best = {}
    for r in clean.collect():
        best[norm(r)] = min(best.get(norm(r), (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert kept(once) == Counter(tuple(r) for r in clean.collect() if best[norm(r)] == (r.doc_id is None, r.doc_id or 0))


def test_one_of_near_copies_stays(stages):
    _, (_, _, once, single, *_) = stages
    got = sorted(once.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    found = list(near_dedup.kmers_of(pa.array([r.text for r in got])))
    root = list(range(len(got)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(got)):
        for j in range(i):
            if found[i][0].tobytes() == found[j][0].tobytes() or near_dedup.aligned(found[i][1], found[j][1]) >= 0.8 - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = Counter(tuple(r) for i, r in enumerate(got) if got[top(i)].doc_id == r.doc_id)  # rows that repeat a doc_id stay together
    assert kept(single) == want and sum(want.values()) < len(got)


def test_the_mix_takes_words_of_its_documents(stages):
    _, (_, _, _, single, mixed, _) = stages
    words = {r.doc_id: Counter((r.text or "").split()) for r in single.collect()}
    taken = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        taken.setdefault(r.doc_id, Counter()).update(r.text.split())
    assert taken and all(n <= 3 * words[d][w] for d, c in taken.items() for w, n in c.items())


def test_the_sequences_hold_all_ids(stages):
    from tokenizers import Tokenizer

    _, (*_, mixed, packed) = stages
    tok = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    pieces = packed.collect()
    assert sum(p.length for p in pieces) == sum(n * c for (_, n), c in want.items())
    assert {(p.doc_id, p.doc_tokens) for p in pieces} == set(want)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert filled.get(p.sequence_id, 0) == p.offset and p.offset + p.length <= 4096
        filled[p.sequence_id] = p.offset + p.length


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality double").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
