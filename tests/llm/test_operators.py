"""Operators against brute force, other libraries or round trips, with the odd cases of their contracts."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from tidemark.llm import bpe, embedding_dedup, imatch, packing, quality, simhash, token_counts, toxicity, warc
from tidemark.llm.common import connected_components, map_batches
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "Same text. " * 3, "Same text. " * 3, "日本語 🙂 " * 50, "x" * 3000, "it's  we'll\t\t x", "a<|endoftext|> b", "word " * 20_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long and repeated texts, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "q", 1, 2.0) for i, t in enumerate(ODD)], "doc_id long, text string, score string, ids int, rank double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def encoding(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(80)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_simhash_links(spark, odd, none):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = list({int(x) for x in base} | {int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in base[:250]} | {0})
    df = spark.createDataFrame([(i, int(np.array(f, np.uint64).view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    got = {r["id"]: r["component"] for r in simhash.link_components(df, 2).collect()}
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= 2
    want = np.arange(len(fps))
    for _ in range(20):
        want = np.array([want[near[i]].min() for i in range(len(fps))])
    assert [got.get(i, i) for i in range(len(fps))] == want.tolist()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert len(found) == len(ODD) and found[5]["component_id"] == 4 and found[1]["component_id"] == found[2]["component_id"] == 0 and found[0]["fp"] == 0
    assert simhash.near_duplicates(none).count() == 0
    pairs = {(i, j) for a, b in simhash.vp_pairs(np.array(fps, np.uint64), 2, leaf=8) for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_simhash_fingerprint_from_its_definition():
    import re

    import xxhash

    rng = random.Random(21)
    for text in [*(t or "" for t in ODD[:-1]), *(" ".join(rng.choice(["Ab", "cD", "é", "x\u00a0y"]) for _ in range(rng.randint(0, 30))) for _ in range(60))]:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(text) == want


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 1), (3, 1), (None, None), (None, None)]
    assert sorted((r["doc_id"] for r in simhash.stage(spark, docs, "").collect()), key=str) == [1, None, None]
    rows = imatch.compare_with_edit(docs, {}, 2).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == [1, 3, None, None] and all((r["near_next"] is None) == (r["doc_id"] is None) for r in rows)
    pages = spark.createDataFrame([(None, "http://a.b/", "x" * 200), (4, "http://a.b/", "x" * 200), (None, None, None)], "page_id long, url string, html string")
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    found = warc.merged_index(path, spark).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"]) for r in found) == [(0, 0, "response"), (0, 200, "response"), (4, 200, "response")]


def test_bpe_is_tiktoken(odd, none):
    enc = encoding("byte_bpe_multi_50k.tiktoken")
    for r in bpe.round_trip(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        text = ODD[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_of_a_word_over_a_mebibyte(tmp_path):
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abab"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks)))
    n = 2**20 + 5
    assert bpe.Bpe(str(tmp_path / "ranks"), r"\S+").encode(["ab" + "x" * n + "ababab"]) == [[256] + [120] * n + [257, 256]]


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).toPandas()
    for doc, rows in got.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        rows = rows.sort_values("piece")
        assert rows["piece"].tolist() == list(range(len(rows))) and rows["length"].sum() == len(ids)
        assert rows["start"].tolist() == [0, *rows["length"].cumsum()[:-1]] and (rows["length"][1:] == 1024).all()
        assert rows["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(rows["start"], rows["length"])]
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum()[:-1]] and rows["length"].sum() <= 1024
    assert set(got["doc_id"]) == set(texts)
    assert got["sequence_id"].nunique() <= 1.01 * np.ceil(got["length"].sum() / 1024) + 1
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def best_fit_bins(counts, capacity=1024):
    """Best fit item by item, longest first: the rooms left."""
    rooms = []
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((fit if fit is not None else capacity) - length)
    return rooms


@pytest.mark.parametrize("scale", [0, 1, 50])
@pytest.mark.parametrize("high", [1025, 400])
def test_plan_uses_each_item_once(scale, high):
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, high, 1500), minlength=1025) * scale
    made = packing.plan(counts)
    assert sum((p * t for p, t in made), np.zeros(1025, int)).tolist() == counts.tolist() and all(p @ np.arange(1025) <= 1024 for p, _ in made)
    fitted = packing.best_fit(counts)
    assert sum((p * t for p, t in fitted), np.zeros(1025, int)).tolist() == counts.tolist()
    if scale < 2:
        rooms = best_fit_bins(counts)
        assert sorted(1024 - int(p @ np.arange(1025)) for p, t in fitted for _ in range(t)) == sorted(rooms)
    bins = sum(t for _, t in made)
    assert bins <= sum(t for _, t in fitted) and len(made) < 4000
    priced, bound = packing.program(counts)  # it covers every length, and its bound is one
    assert (sum((p * x for p, x in priced), np.zeros(1025)) >= counts - 1e-6).all()
    assert counts @ np.arange(1025) / 1024 <= bound + 1e-6 <= sum(x for _, x in priced) + 1e-3


@pytest.mark.parametrize("sizes, bins", [({342: 3000, 341: 3000, 680: 1000}, 2750), ({520: 900, 350: 1500, 160: 2200, 340: 700}, 1575), ({1024: 5}, 5), ({600: 7}, 7), ({}, 0)])
def test_plan_solves_the_program(sizes, bins):
    counts = np.zeros(1025, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    made = packing.plan(counts)
    assert sum(t for _, t in made) == bins
    assert sum((p * t for p, t in made), np.zeros(1025, int)).tolist() == counts.tolist()
    assert packing.program(counts)[1] <= bins + 1e-6


def test_plan_on_small_histograms():
    """The fewest bins by trying all patterns, on capacity 12; and never fewer than the bound."""
    from functools import lru_cache
    from itertools import product

    rng = np.random.default_rng(8)
    for _ in range(12):
        sizes = sorted(rng.choice(np.arange(2, 11), 3, replace=False).tolist())
        want = tuple(rng.integers(1, 5, 3).tolist())
        patterns = [a for a in product(range(7), repeat=3) if 0 < sum(n * s for n, s in zip(a, sizes, strict=True)) <= 12]

        @lru_cache(None)
        def fewest(left, patterns=tuple(patterns)):
            if not any(left):
                return 0
            return 1 + min(fewest(tuple(a - b for a, b in zip(left, p, strict=True))) for p in patterns if all(a >= b for a, b in zip(left, p, strict=True)))

        counts = np.zeros(13, np.int64)
        counts[sizes] = want
        bins = sum(t for _, t in packing.plan(counts))
        assert fewest(want) <= bins <= fewest(want) + 1 and packing.program(counts)[1] <= fewest(want) + 1e-6


def test_plan_takes_patterns_of_the_program():
    counts = np.bincount(np.random.default_rng(5).integers(1, 1025, 60_000), minlength=1025)
    counts[-1] = 7
    made, fitted = packing.plan(counts), packing.best_fit(counts)
    assert sum(t for _, t in made) <= sum(t for _, t in fitted)
    keys = {p.tobytes() for p, _ in packing.program(counts * (np.arange(1025) < 1024))[0]}
    assert sum(t for p, t in made if p.tobytes() in keys) > 0.05 * sum(t for _, t in made)


def test_packing_stage(spark, odd, none):
    out = packing.stage(spark, odd, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(range(len(ODD))) and packing.stage(spark, none, SF).count() == 0


def test_imatch(spark, odd, none):
    docs = odd.select("doc_id", "text")
    kept = imatch.lexicon(docs, 0.0, 1.0)
    got = {r["doc_id"]: r for r in imatch.compare_with_edit(docs, kept, 4).collect()}
    assert sorted(got) == list(range(len(ODD)))
    for i, t in enumerate(ODD):
        t, after = t or "", ODD[(i + 1) % len(ODD)] or ""
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == imatch.written(imatch.signature(t, kept)) and got[i]["edited_fingerprint"] == imatch.written(imatch.signature(changed, kept))
        assert 0 <= got[i]["near_edited"] <= 1 and got[i]["near_next"] == imatch.likeness(imatch.signature(t, kept), imatch.signature(after, kept))
    assert got[4]["near_next"] == 1.0 and got[4]["fingerprint"] == got[5]["fingerprint"]
    assert imatch.compare_with_edit(none, {}, 4).count() == 0
    df = {r["term"]: r["df"] for r in imatch.document_frequencies(docs).collect()}
    assert df["word"] == 1 and df["same"] == 2


def test_edit_counts(spark, odd, none):
    enc = encoding("byte_bpe_50k.tiktoken")
    rng = random.Random(6)
    rows, want = [], {}
    for i, t in enumerate([*ODD, *["".join(rng.choice("ab '\n\t1.,é日s!r") for _ in range(200)) for _ in range(40)]]):
        edits = [(rng.randrange(0, 220), rng.choice([0, 1, 30]), rng.choice(["", " ", "'", "re", "zz z"])) for _ in range(4)] + [(None, None, None)]
        rows.append((i, t, edits))
        now = t or ""
        for s, n, a in edits[:4]:
            s = min(s, len(now))
            now = now[:s] + a + now[s + n :]
        want[i] = (len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(now)))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDIT}")
    got = {r["doc_id"]: (r["n_tokens"], r["edited_tokens"]) for r in token_counts.count_with_edits(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert got == want
    long = token_counts.CountTree("a few words " * 5000, token_counts.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    long.edit(20_000, 5, "other")
    assert long.reencoded < 10
    assert token_counts.count_with_edits(token_counts.standard_edits(none), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_warc(spark):
    big = "<p>é" + "x\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(1, "http://b.example.org/x", big), (2, "https://www.a.example.org/?Q=1", None), (3, None, big), (4, "http://b.example.org/x\r\nno", ""), (5, "::", "short"), (6, "http://b.example.org/x", big), (7, "h", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    got = warc.merged_index(path, spark, range_rows=2).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows)))
    assert [(r["url_key"], r["captured_at"], r["page_id"]) for r in got] == sorted((r["url_key"], r["captured_at"], r["page_id"]) for r in got)
    seen = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert seen[i] == (len(raw), hashlib.sha256(raw).hexdigest(), *(("revisit", 1) if i in (3, 6) else ("response", None)))
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.merged_index(path, spark).count() == 0


def test_warc_repeated_pages_and_clashing_columns(spark):
    big = "<p>" + "y" * 200
    rows = [(1, "http://a.org/", big, 0, 9, "d", 3), (1, "http://a.org/", big, 0, 9, "d", 3), (None, "http://a.org/", big, 0, 9, "d", 3), (5, "http://b.org/", big, 0, 9, "d", 3)] + [(10 + i, "http://hot.org/x", f"{i}", 0, 9, "d", 3) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, range int, position long, digest string, bytes int").repartition(5)
    path = warc.scratch_path(spark, "warc")
    warc.write_archives(pages, path, file_bytes=20_000)
    got = warc.merged_index(path, spark, range_rows=16).orderBy("position").collect()
    keys = [(r["url_key"], r["captured_at"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert keys == sorted(keys) and [r["position"] for r in got] == list(range(204)) and len({r["range"] for r in got}) > 4
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] > 100) == [(0, "response", None), (1, "response", None), (1, "response", None), (5, "revisit", 1)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


def cosines_of(query, vectors):
    """Every cosine, term by term."""
    return [sum(w * v.get(t, 0.0) for t, w in query.items()) for v in vectors]


def unit(counts, weights):
    v = {t: (1 + np.log(n)) * weights[t] for t, n in counts.items() if t in weights}
    size = np.sqrt(sum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()}


def indexed(weights, examples, block):
    terms = {t: i for i, t in enumerate(weights)}
    known = [{t: n for t, n in c.items() if t in terms} for _, c, _ in examples]
    own = np.array([terms[t] for c in known for t in c], int), np.array([n for c in known for n in c.values()], int)
    return toxicity.BlockMaxIndex(terms, np.array(list(weights.values())), np.array([d for d, *_ in examples]), np.array([y for *_, y in examples]), own, np.array([len(c) for c in known]), block)


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_block_max_is_exact(block):
    rng = random.Random(8)
    idf = {f"t{i}": 1 + rng.random() * 5 for i in range(60)}
    docs = [(i, {f"t{min(rng.randrange(65), rng.randrange(65))}": rng.randint(1, 4) for _ in range(rng.randint(0, 6))}, i % 2) for i in range(300)]
    index = indexed(idf, docs, block)
    assert 0 < len(index.rows) < len(idf)
    vectors = [unit(c, idf) for _, c, _ in docs]
    for (doc, counts, _), (found, cosines) in zip(docs[:150], index.nearest_of([c for _, c, _ in docs[:150]], 7, [d if d % 3 else None for d, *_ in docs[:150]]), strict=True):
        every = sorted(((round(c, 12), -i) for i, c in enumerate(cosines_of(unit(counts, idf), vectors)) if i != doc or not doc % 3), reverse=True)
        want = [(c, -i) for c, i in every if c > 0][:7]
        assert np.allclose(cosines, [c for c, _ in want]) and [int(index.docs[e]) for e in found] == [i for _, i in want]
    assert len(indexed(idf, [], 4).nearest(docs[5][1], 7)[0]) == 0


def test_toxicity_against_brute_force(spark):
    """Vocabulary, weights, neighbours and votes on documents, from their definitions: all terms of all labelled rows count."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    for r in sorted(labels.where("toxic is not null").collect(), key=lambda r: r["doc_id"]):
        if r["doc_id"] in texts:
            first, y = seen.get(texts[r["doc_id"]], (r["doc_id"], 0))
            seen[texts[r["doc_id"]]] = (first, max(y, r["toxic"]))
    rows = [(d, toxicity.term_counts(t), y) for t, (d, y) in seen.items()]
    n1 = sum(y for *_, y in rows)
    base = (n1 + 0.5) / (len(rows) + 1)
    counts = {d: toxicity.term_counts(t) for d, t in texts.items()}
    weights = {}
    for t in {t for _, c, _ in rows for t in c}:
        a, b = sum(t in c for _, c, y in rows if not y), sum(t in c for _, c, y in rows if y)
        odds = np.log((b + 5 / min(base, 1 - base) * base) / (a + 5 / min(base, 1 - base) * (1 - base))) - np.log(base / (1 - base))
        weights[t] = (np.log((1 + len(texts)) / (1 + sum(t in c for c in counts.values()))) + 1) * (0.05 + odds**2)
    vectors = [unit(c, weights) for _, c, _ in rows]
    votes = {}
    for d in list(texts)[::4]:
        every = sorted(((round(c, 12), -r[0], r[2]) for r, c in zip(rows, cosines_of(unit(counts[d], weights), vectors), strict=True) if c > 0), reverse=True)[:31]
        assert np.allclose([e["cosine"] for e in got[d]["evidence"]], [c for c, *_ in every], atol=1e-9)
        assert sum(e["doc_id"] == -i for e, (_, i, _) in zip(got[d]["evidence"], every, strict=True)) >= len(every) - 2  # all but ties in the last digits
        w = [1 / (1.1 - min(c, 1)) for c, *_ in every]
        votes[d] = (sum(x * y for x, (*_, y) in zip(w, every)) + 6 * base) / (sum(w) + 6) if every else None
    order = sorted((d for d in votes if votes[d] is not None), key=votes.get)
    scores = [got[d]["score"] for d in order]
    assert all(a <= b + 1e-9 for a, b in zip(scores, scores[1:])) and scores[0] < 0.3
    assert sum(not r["evidence"] for r in got.values()) < 0.05 * len(got)


def test_toxicity_stage_keeps_columns(spark, odd, none):
    for docs in (odd, odd.limit(0)):
        out = toxicity.stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema and out.count() <= docs.count()


def test_scores_on_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (4, None, 1), (8, 1, 1), (10, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.train(odd, labels)
        got = module.score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(none, model).count() == 0
        assert module.score(odd, module.train(none, labels.limit(0))).count() == len(ODD)


def test_toxicity_keeps_the_labelled_share_under_a_cap(spark):
    rng = random.Random(12)
    rows = [(i, int(rng.random() < 0.1)) for i in range(3000)]
    rows = [(i, ("bad" if rng.random() < (0.8 if y else 0.15) else "good") + f" w{i}", y) for i, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), examples=100)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for word in ("bad", "good"):
        share = np.mean([y for _, t, y in rows if t.startswith(word)])
        assert abs(np.mean([got[i] for i, t, _ in rows if t.startswith(word)]) - share) < 0.12
    assert abs(np.mean(list(got.values())) - np.mean([y for *_, y in rows])) < 0.05


@pytest.mark.parametrize(("name", "label", "least"), [("op1_bradley_terry_quality", "quality", 0.95), ("op4_toxicity_nearest", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    got = got[got["held_out"]]
    assert (got["predicted"] == got[label]).mean() >= least


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for size, noise in [(1, 0), (70, 0.02), (30, 0.035), (5, 0), (2, 0.03)] + [(1, 0)] * 150:
        centre = rng.standard_normal(24)
        for _ in range(size):
            x = centre / np.linalg.norm(centre) + noise * rng.standard_normal(24)
            rows.append((i, [float(np.float32(v)) for v in x], int(i % 2 if size == 30 else size % 3)))
            i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 24, 1), (i + 2, [float("nan")] * 24, 1), (i + 3, [None] * 24, 1), (i + 4, rows[1][1], None), (i + 5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    good = [(v, np.array(x) / np.linalg.norm(x), y) for v, x, y in rows if v < i]
    near = {v: {u for u, z, w in good if u != v and w == y and float(x @ z) >= 0.93} for v, x, y in good}
    want = sum(map(len, near.values()))
    assert all(got[v]["n_links"] <= len(near[v]) for v in near) and sum(got[v]["n_links"] for v in near) >= 0.9 * want > 0
    comp = {v: v for v in near}
    for _ in range(30):
        comp = {v: min([comp[v], *(comp[u] for u in near[v])]) for v in near}
    assert sum(got[v]["component_id"] == comp[v] for v in near) >= 0.97 * len(near)
    assert all(got[i + k]["n_links"] == 0 and got[i + k]["kept"] for k in range(6))
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_embedding_rows_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, b, 1), (1, a, 0), (2, [1.0, 0.01, 0.1], 0), (3, [0.01, 1.0, 0.1], 1), (4, a, 5), (4, a, 5), (5, a, 5)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False)]


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n[:4] not in ("op12", "op13")])
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    key = want.columns.tolist()
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert set(out["doc_id"]) < set(docs["doc_id"]) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert kept.columns == docs.columns.tolist() and 0.7 * len(docs) < kept.count() < len(docs)
