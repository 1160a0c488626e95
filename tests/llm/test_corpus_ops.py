"""Packing, token files, joins, embeddings, mixing and the pipeline."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thalweg.llm import blocks, components, embed_dedup, mixing, ngram_join, packing, queries, token_codes
from thalweg.llm.common import scratch_path
from thalweg.llm.tokens import WordBpe


@pytest.fixture(scope="module")
def tokenizer():
    return WordBpe(queries.vocabulary())


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_fast_encoding_equals_the_library(tokenizer, rows):
    odd = ["It's DON'T we'll", "x\x1cy \x85z \xa0q", "İstanbul ŉ ſ K ß Ÿ", "½²³ ª º µ", "<|endoftext|> a", "é é", "٣ 4५", *(chr(c) + "a " + chr(c).upper() for c in range(1, 0x250))]
    for text in odd + [t or "" for _, t, *_ in rows]:
        assert tokenizer.encode(text).tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


def test_codes_give_any_token_back():
    rng = np.random.default_rng(1)
    ids = rng.choice([0, 1, 255, 256, 257, 65535, 65536, 2**24, 2**32 - 1, 49407], 3000).astype(np.uint32)
    codes = token_codes.Codes(*token_codes.Codes.build(ids))
    assert codes.slice(0, 3000).tolist() == ids.tolist()
    for i in [0, 1, 511, 512, 513, 2999, *rng.integers(0, 3000, 200)]:
        assert codes[int(i)] == ids[i]
    for a, b in ((5, 5), (511, 1025), (2990, 3000)):
        assert codes.slice(a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark, docs, rows, wide, no_docs, tokenizer):
    for frame in (docs, wide):
        got = token_codes.write_read(spark, frame, queries.vocabulary(), 2, scratch_path(spark, "t")).collect()
        want, at = [], 0
        for i, text in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            ids = ids_of(tokenizer, text, 2)
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_codes.write_read(spark, no_docs, queries.vocabulary(), 2, scratch_path(spark, "t")).count() == 0


def test_single_tokens_by_address(spark, docs, rows, tokenizer):
    path = scratch_path(spark, "t")
    token_codes.encode(docs.where("doc_id < 20"), queries.vocabulary(), 2, segment_tokens=100).write.parquet(path)
    asked = spark.createDataFrame([(3, 0), (3, 17), (7, 5), (7, 10**6), (7, -1), (99, 0)], "doc_id long, at long")
    got = {(r.doc_id, r.at): r.token for r in token_codes.tokens(spark.read.parquet(path), asked).collect()}
    ids = {i: ids_of(tokenizer, t, 2) for i, t, *_ in rows}
    assert got == {(3, 0): ids[3][0], (3, 17): ids[3][17], (7, 5): ids[7][5], (7, 10**6): None, (7, -1): None, (99, 0): None}


def test_hilbert_is_a_continuous_bijection():
    side = 8
    grid = np.array(np.meshgrid(*[np.arange(side)] * 3, indexing="ij")).reshape(3, -1).T
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(side**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, rows, wide, no_docs, tokenizer):
    for frame in (docs, wide):
        out = packing.pack(frame, queries.vocabulary(), 1, 64).toPandas()
        want = sorted((-1 if i is None else i, ids_of(tokenizer, t, 1).tobytes()) for i, t, *_ in rows)
        total = sum(len(b) // 4 for _, b in want)
        assert out.length.sum() == total
        for seq, g in out.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
            n = int(g.length.sum())
            assert n <= 64 and n & (n - 1) == 0
        for i, text, *_ in rows:
            ids = ids_of(tokenizer, text, 1)
            g = out[out.doc_id.isna() if i is None else out.doc_id == i]
            for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True):
                assert c == zlib.crc32(ids[s : s + n].tobytes())
    assert packing.pack(no_docs, queries.vocabulary(), 1).count() == 0
    with pytest.raises(ValueError):
        packing.cut(docs, 100)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    for edges in ([(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))], [(i, i + 1) for i in range(70)], [(5, 5)], []):
        frame = spark.createDataFrame(edges, "a long, b long")
        root = {v: v for e in edges for v in e}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
        assert {r.node: r.root for r in components.components(frame).collect()} == want


def test_forest_of_links():
    uids = np.array([30, 10, 20, 40, 50])
    assert blocks.forest(uids, np.array([0, 1]), np.array([2, 2])).tolist() == [10, 10, 10, 40, 50]


def closure(ids, linked):
    n = len(ids)
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in linked[i]:
                root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root[i]] = min(least.get(root[i], ids[i]), ids[i])
    return [least.get(r) for r in root]


def test_ngram_join_equals_all_pairs(docs, rows, wide, no_docs):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    ids = [r[0] for r in rows]
    comp = closure(ids, linked)
    want = sorted(repr((i, len(x), c)) for i, x, c in zip(ids, linked, comp, strict=True))
    for options in ({}, {"per_block": 2}):
        got = ngram_join.links(docs, **options).collect()
        assert sorted(repr((r.doc_id, r.n_links, r.component_id)) for r in got) == want
    assert ngram_join.links(wide).count() == len(rows)
    assert ngram_join.links(no_docs).count() == 0


def test_representatives(docs, wide):
    left = ngram_join.representatives(wide)
    assert left.columns == wide.columns
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and {0, 26, 22, 23, 24, 25, 4} <= set(ids) and not {20, 21, 27, 30} & set(ids)


def test_stop_depth_reaches_the_recall():
    d = ngram_join.stop_depth(0.8, 8, 24, 0.995)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.995 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def vectors():
    rng = np.random.default_rng(6)
    out = []
    for g in range(6):
        c = rng.standard_normal(16)
        out += [(None, (c + rng.standard_normal(16) * s).tolist(), g % 3) for s in rng.choice([0.0, 0.02, 0.04, 0.3], 25)]
    x = out[0][1]
    out += [(None, None, 0), (None, [0.0] * 16, 0), (None, [float("nan")] * 16, 0), (None, [float("inf"), *x[1:]], 0), (None, [None, *x[1:]], 0), (None, x, None), (None, x[:8], 0), (None, [v * 1e200 for v in x], 0), (None, [v * 1e-200 for v in x], 0)]
    return [(k, v, g) for k, (_, v, g) in enumerate(out)]


def test_embedding_links_equal_all_pairs(spark):
    rows = vectors()
    unit = []
    for _, v, _ in rows:
        a = np.array([np.nan if t is None else t for t in v], float) if v else np.zeros(1)
        unit.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()) if np.isfinite(a).all() and np.abs(a).max() > 0 else None)
    ok = lambda i, j: i != j and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    linked = [[j for j in range(len(rows)) if ok(i, j)] for i in range(len(rows))]
    comp = closure([r[0] for r in rows], linked)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for options in ({}, {"per_block": 5}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.links(frame, **options).collect()}
        assert got == {i: (len(x), c, c == i) for i, x, c in zip(range(len(rows)), linked, comp, strict=True)}
    more = frame.withColumns({c: F.lit(1) for c in ("row", "unit", "uid", "weight", "keys")})
    assert embed_dedup.links(more).count() == len(rows)
    assert embed_dedup.links(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 64))
    x /= np.linalg.norm(x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * (u := y - (y @ x) * x) / np.linalg.norm(u)
    errors = []
    for seed in range(400):
        turn = embed_dedup.rotations(64, 1, seed)
        s = np.sign(turn @ x) / 8
        errors.append(s @ (turn @ y) / (s @ (turn @ x)) - 0.9)
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 6 * np.sqrt(1 - 0.81) * 0.76 / np.sqrt(63)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(docs, rows, wide, no_docs):
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = brute_targets(sizes)
    first = mixing.mix(docs).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    assert len(first) == len(rows)
    taken = {}
    for r in first:
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mixing.mix(wide).count() == len(rows) and mixing.mix(no_docs).count() == 0


def test_better_documents_are_drawn_first(spark):
    frame = spark.range(4000).selectExpr("id doc_id", "'s' source", "10L size", "if(id % 2 = 0, 1.0D, 0.1D) quality")
    more = frame.unionAll(spark.range(1).selectExpr("-1L", "'z'", "20000L", "1.0D"))
    out = mixing.plan(more.repartition(4)).where("source = 's'").groupBy("quality").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    t = {r.quality: r.t for r in out}
    assert t[1.0] > t[0.1] and abs(sum(t.values()) - out[0].g) <= 1


def test_mixed_documents_repeat_whole(docs, wide):
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns
    assert out.where("text is null or text = ''").count() == 0


def test_mix_equals_its_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.oracle_sql()['op10_mixing']})").fetchall())
    assert sorted(map(tuple, queries.op10_mixing(spark, sf_dir).collect())) == want


def test_stages_keep_columns_on_odd_documents(spark, wide, sf_dir):
    docs = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        path = scratch_path(spark, "stage-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_on_no_documents(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_pipeline_decisions_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = docs.count()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert n > left["quality rules"] >= left["line dedup"] >= left["n-gram Jaccard join"] > 0
    assert ngram_join.links(docs.dropDuplicates(["doc_id"])).agg(F.max("n_links")).first()[0] == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert os.path.basename(sf_dir)
