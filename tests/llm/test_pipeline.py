"""Each stage of the pipeline on what the one before left, against SQL or brute force over whole tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thalweg.llm import ngram_join, quality, queries
from thalweg.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of every stage and what the last one gives, as frames."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append((name, docs))
        docs = materialise(stage(spark, docs, sf_dir), "stage-test")
    return [*out, (corpus_pipeline.STAGES[-1][0], docs)]


def sql(frame, text):
    """The SQL of a query with ``frame`` as its documents."""
    duck = duckdb.connect()
    files = [f.removeprefix("file:") for f in frame.inputFiles()]
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({files})")
    return duck.execute(text).fetchdf()


def both(stages, name):
    k = [n for n, _ in stages].index(name)
    return stages[k][1], stages[k + 1][1]


def test_quality_rules_reject_what_they_say(spark, sf_dir, stages):
    """The base verdict of every document from its words, counted in plain Python, and who is left."""
    docs, left = both(stages, "quality rules")
    judged, stats, failed, kept = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdicts = {r.doc_id: r for r in judged.select("doc_id", "text", F.col(stats).alias("stats"), F.col(failed).alias("failed"), F.col(kept).alias("kept")).collect()}
    for r in verdicts.values():
        words = (r.text or "").encode().split()
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        twice = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.stats.n_words, r.stats.n_repeat_words) == (len(words), len(twice))
        assert r.failed == (len(words) < 10 or 100 * len(twice) > 20 * len(words))
        assert not (r.failed and r.kept)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(d for d, r in verdicts.items() if r.kept)


def test_lines_left_equal_the_sql(stages):
    docs, left = both(stages, "line dedup")
    want = sql(docs, queries._LINES)
    want = want[(want.n_removed == 0) | (want.n_lines > want.n_removed)]
    got = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(r.text)) for r in left.where("text is not null").collect()}
    assert got == set(zip(want.doc_id, want.text_sha256, want.chars_left)) - {(r.doc_id, hashlib.sha256(b"").hexdigest(), 0) for r in left.where("text is null").collect()}
    assert all(r.n_chars == len(r.text) for r in left.where("text is not null").collect())


def test_one_document_of_each_group_stays(stages):
    docs, left = both(stages, "n-gram Jaccard join")
    want = sql(docs, queries._NGRAM)
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(want[want.kept].doc_id)


def test_the_mix_takes_its_targets(stages):
    docs, left = both(stages, "mixing sources")
    want = sql(docs, queries._MIX)
    size = dict(zip(want.doc_id, want["size"]))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target = collections.Counter(), {}
    for d, t in zip(want.doc_id, want.target):
        target[source[d]] = t
    copies = collections.Counter(r.doc_id for r in left.select("doc_id").collect())
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
        assert n * size[d] <= 3 * size[d]
    largest = max(size.values())
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())


def test_packed_pieces_read_back(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    name, docs = stages[-1]
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    tokenizer.encode_special_tokens = False
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.select("doc_id", "text").collect()}
    times = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    covered, filled = collections.Counter(), collections.defaultdict(int)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        covered[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert covered == {d: n * len(ids[d]) for d, n in times.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())


def test_rows_without_words_all_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "a"), (None, "", "b"), (5, None, "a"), (5, None, "b"), (7, " \n", "a"), (7, " \n", "a"), (8, "one two three", "a"), (8, "one two three", "b"), (9, "one two three", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = collections.Counter(map(tuple, ngram_join.representatives(docs).select("doc_id", "text").collect()))
    assert left == {(None, None): 2, (None, ""): 2, (5, None): 2, (7, " \n"): 2, (8, "one two three"): 1}
