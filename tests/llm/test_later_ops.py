"""Conversation repair, piece ids and importance resampling."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from thalweg.llm import pieces, queries, repair, resampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")
STEP = {"0s": "1", "0u": "2", "1u": "2", "2a": "3", "3u": "2"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, lines) of the cheapest edits, least in ASCII, from all partial ways kept by state."""
    best = {"0": (0, "", ())}

    def better(states, state, way):
        if state and (state not in states or way[:2] < states[state][:2]):
            states[state] = way

    def inserted(states):
        states = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                for role, name in NAMES.items():
                    better(states, STEP.get(state + role), (cost + 3, audit + "I", (*lines, f"{name}:")))
        return states

    for role, text, fault in turns:
        now = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(now, state, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    better(now, STEP.get(state + role[0]), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for r, name in NAMES.items():
                    better(now, STEP.get(state + r), (cost + 3 + more, audit + "R", (*lines, f"{name}:{text}")))
        best = now
    best = inserted(best)
    return min((best[q] for q in "03" if q in best), key=lambda x: x[:2])


def repaired(rows):
    """The result of op11 for rows of (conv_id, turn, role, text)."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        shown = [" " if v is None else v for v in (conv, turn, role, text)]
        k = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", shown[3]) if k == 2 else shown[3]
        own += [(turn, "user" if k == 4 else shown[2], text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            turns.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None))
            seen.add((role, text))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        counts = [sum(f == k for _, _, f in turns) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(2)
    rows = []
    for conv in (None, *range(150)):
        for turn in range(rng.choice([0, 1, 2, 3, 6, 12, 30])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Hi.", "Yes", "ok!", "", " \n", "What?", None, f"text {rng.random()}.", f"cut {rng.random()}", "é😀.\n "])
            rows.append((conv, rng.choice([turn, turn, turn, None, rng.randint(0, 5)]), role, text))
    rows += [rows[-1]] * 5  # repeated rows
    rows += [(999, t, rng.choice(["user", "assistant", "tool"]), f"t{rng.randint(0, 900)}" + rng.choice(".?x")) for t in range(1200)]
    return rows + [(1000, 0, "user", "long " * 40_000 + ".")]


@pytest.mark.parametrize("cell", (4, 64, 4096))
def test_repair_equals_all_ways_kept(spark, tmp_path, monkeypatch, cell):
    """Whatever the size of a cell, also where a conversation lies in hundreds of blocks; further columns are ignored."""
    monkeypatch.setattr(repair, "CELL", cell)
    rows = odd_turns()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("at", "steps", "fault", "digest", "copy", "k")})
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()} == repaired(rows)


def test_repair_of_whole_tables(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, sf_dir).collect()} == repaired(rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_repair(spark, str(tmp_path)).count() == 0


def test_repair_edits_read_back(spark):
    rows = [(1, 0, "tool", "Use this."), (1, 1, "assistant", "Done."), (1, 2, "assistant", "Again."), (1, 3, "user", " ")]
    done = repair.Repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    edits = [(r.edit, r.role, r.text) for r in done.edited().orderBy("at", "step").collect()]
    assert edits == [("R", "user", "Use this."), ("K", "assistant", "Done."), ("I", "user", ""), ("K", "assistant", "Again."), ("D", None, None)]
    one = done.audit().first()
    assert (one.cost, one.audit, one.blank, one.illegal) == (10, "RKIKD", 1, 2)


def test_bucket_queue_gives_least_distances():
    """Against relaxing all arcs until nothing changes."""
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(rng.choice("suaSUA-+d") for _ in range(rng.randint(0, 12)))
        ends = repair._GOAL if rng.random() < 0.5 else [rng.randint(5, 9) for _ in range(4)]
        n = len(codes)
        best = {(n, q): e for q, e in enumerate(ends)}
        for _ in range(6 * (n + 1)):
            for place in range(n + 1):
                arcs = [(place, p, q, c) for p, q, c, _ in repair._ADDED] + ([(place + 1, p, q, c) for p, q, c, _ in repair._TURN[codes[place]]] if place < n else [])
                for to, p, q, c in arcs:
                    best[place, p] = min(best.get((place, p), 1 << 40), c + best.get((to, q), 1 << 40))
        got = repair.distances(codes, ends)
        assert all(min(1 << 40, v) == got[4 * k[0] + k[1]] for k, v in best.items())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library):
    own, rng = pieces.Pieces(MODEL, keep=2000), random.Random(4)
    some = [*"aaaabcdetherin  \n▁ 's.,0123", "é", "漢", "😀", "\t", "ing", "the ", "▁of", "\x00", "﻿", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [" " * rng.randint(0, 70) + "x" * rng.randint(0, 3) + " " * rng.randint(0, 40) + rng.choice(["", "\n", "a"]) for _ in range(1000)]
    texts += ["", " ", "x" * 60_000, "ab" * 30_000, "".join(rng.choice("abcdehinort") for _ in range(60_000)), " " * 60_000, "漢" * 20_000, "ĳ" * 5000]
    for text in texts:
        ids = own.encode(text)
        want = library.encode(text)
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want)


def test_any_ids_decode_as_in_the_library(library):
    own, rng = pieces.Pieces(MODEL), random.Random(5)
    pool = [0, 1, 2, 13, 259, 260, 264, 261, 28705, 29871, *range(3, 259), *range(300, 330)]
    for _ in range(20_000):
        ids = [rng.choice(pool) if rng.random() < 0.7 else rng.choice([1, 2, 28705, 259, 264]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_op12_on_whole_tables_and_odd_rows(spark, sf_dir, docs, rows, wide, no_docs, library, tmp_path):
    def want(text):
        ids = library.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_pieces(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *want(r.text)) for r in texts)
    wide.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = queries.op12_pieces(spark, f"{tmp_path}/odd").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *want(r[1])) for r in rows), key=repr)
    clash = docs.withColumn("piece_ids", F.lit("own")).withColumn("decoded", F.lit("too"))
    coded, ids = pieces.encode(clash, MODEL)
    back, text = pieces.decode(coded, MODEL, ids)
    assert {ids, text}.isdisjoint(clash.columns) and back.where("piece_ids = 'own' and decoded = 'too'").count() == len(rows)
    none, name = pieces.encode(no_docs, MODEL)
    assert pieces.decode(none, MODEL, name)[0].count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled(docs, target, least=20, percent=25):
    """The result of op13 for (doc_id, text) and texts."""

    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    each = [(doc, *features(text)) for doc, text in docs]
    s, t = (Counter(bucket(f) for own in some for f in own) for some in ([x[2] for x in each], [features(x)[1] for x in target]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + 10_000) / ((s[k] + 1) * (n_t + 10_000)))) for k in range(10_000)]
    rows = []
    for doc, n, own in each:
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in rows), key=repr)


def test_resampling_equals_counting(spark, sf_dir, wide, rows, docs, no_docs):
    def got(frame):
        return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)

    whole = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark")]
    want = resampled([(r.doc_id, r.text) for r in whole[0].collect()], [r.text for r in whole[1].collect()])
    assert got(resampling.resample(*whole)) == want
    query = sorted((tuple(r) for r in queries.op13_resampling(spark, sf_dir).collect()), key=repr)
    assert query == sorted(((r[0], *r[2:]) for r in want), key=repr)
    target = spark.createDataFrame([("One TWO three ß É four",), (None,)], "text string")
    odd = [(r[0], r[1]) for r in rows]
    assert got(resampling.resample(wide, target)) == resampled(odd, ["One TWO three ß É four"])
    assert got(resampling.resample(docs, target.limit(0), percent=100, least=0)) == resampled(odd, [], 0, 100)
    assert got(resampling.resample(no_docs, target)) == []


def test_features_of_batches_do_not_mix():
    own = resampling.Features(10_000, keep=3)
    for texts in ([b"a b", b"b a b", b""], [b"", b"c d e"], [b"a"]):
        doc, bucket, n = own.of(texts)
        for k, text in enumerate(texts):
            words = text.split()
            want = Counter(zlib.crc32(f) % 10_000 for f in words + [a + b" " + b for a, b in zip(words, words[1:])])
            assert Counter(bucket[doc == k].tolist()) == want and n[k] == len(words)


@pytest.mark.parametrize("name", ("op11_repair", "op13_resampling"))
def test_sql_agrees(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    theirs = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=repr) == sorted(map(tuple, theirs.fetchall()), key=repr)
