"""The training-data operators against brute force, on edge cases and on damaged input."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import budget_mix, chain_dedup, chat_roundtrip, common, decontaminate, kd_shards, line_minhash, multi_index, queries, simhash_bytes, toxic_cnn, warc_salvage

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: null, empty, blank, very long, repeated rows, null ids; columns whose names operators use inside.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, prose(4, 30000)), (5, prose(5, 80)), (5, prose(5, 80)), (6, prose(5, 80)), (None, prose(7, 60)), (8, "x"), (9, "\u00e9\u0130 \u4f60\u597d <|im_end|>")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "en" if i != 8 else None, None if i == 9 else "s1", 0, "c", 1.0, "k") for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long, size string, score double, row string")


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, 100), (None, 3)]
    got = dict(common.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {n: n for p in pairs if None not in p for n in p}
    for _ in range(80):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_staged_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(blocks.getAllFiles().mkString("|")).split("|") if "/shuffle_" in f}
    before, conf = files(), {k: spark.conf.get(k, None) for k in common._WRITING}
    out = common.staged(spark.range(5000).repartition(7).groupBy((F.col("id") % 50).alias("k")).count(), "test")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 50 and conf == {k: spark.conf.get(k, None) for k in common._WRITING}


def test_word_hashes_in_blocks(monkeypatch):
    data = prose(1, 5000).encode()
    whole = common.word_hashes(data)
    monkeypatch.setattr(common, "BLOCK", 777)
    assert (common.word_hashes(data) == whole).all() and len(whole) == 5000


def test_chat_round_trips(spark, empty):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<|b", "", "<|im_end|>\n<|im_start|>user\nx", "<|esc|>", "\\<|im_start|>\\"]
    rows = [(1, i, "assistant" if i % 2 else "us<er%\n", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 0, "user", "x"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat_roundtrip.format_chats(df).collect()}
    assert list(got[1].texts) == nasty and got[2].n_turns == 2 and got[None].n_turns == 1
    said = [got[1].formatted[s.start : s.end] for s in got[1].loss_spans]
    marked = [got[1].formatted[: s.start - 1].endswith(chat_roundtrip.ESCAPED) for s in got[1].loss_spans]
    assert [chat_roundtrip.unescape(x) if m else x for x, m in zip(said, marked, strict=True)] == nasty[1::2]
    assert chat_roundtrip.format_chats(df.limit(0)).count() == 0


def test_warc_salvage_and_round_trip(spark):
    recs = [warc_salvage.encode_record(str(i), f"http://x/{i}\r\n", prose(i, 50).encode(), None) + b"\r\n\r\n" for i in range(4)]
    bad = bytearray(recs[1])
    bad[-20] ^= 1
    got = warc_salvage.read_archive(recs[0] + bytes(bad) + b"junk" + recs[2] + recs[3][:-30])
    assert [x.headers["warc-record-id"][-2] for x in got if isinstance(x, warc_salvage.Record)] == ["0", "2"]
    gaps = [x for x in got if isinstance(x, warc_salvage.Gap)]
    assert sum(x.length for x in gaps) == len(bad) + 4 + len(recs[3]) - 30
    z = [gzip.compress(r) for r in recs]
    cut = z[1][:40] + b"\0\0\0\0" + z[1][44:]
    again = warc_salvage.read_archive(z[0] + cut + z[2])
    assert [x.headers["warc-record-id"][-2] for x in again if isinstance(x, warc_salvage.Record)] == ["0", "2"]
    pages = spark.createDataFrame([(3, "u", "same"), (1, "u", "same"), (2, None, None), (4, "v", ""), (5, "v", "\u00e9\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").withColumn("record", F.lit(0))
    path = common.new_path(spark, "t")
    warc_salvage.write_archives(warc_salvage.records(pages), path)
    back = {r.record_id: r for r in warc_salvage.read_archives(spark, path).collect() if r.kind == "record"}
    assert {k: (v.record_type, v.refers_to) for k, v in back.items()} == {"1": ("response", None), "3": ("revisit", "1"), "2": ("response", None), "4": ("revisit", "2"), "5": ("response", None)}
    assert back["5"].payload.decode() == "\u00e9\r\n\r\nWARC/1.1\r\n" and back["3"].payload_bytes == 4


def test_damaged_archives_lose_what_was_hit_alone(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "'u' || id as url", "repeat('text ' || id || ' ', 40) as html")
    for kind in ("gzip", "none"):
        path = f"file://{tmp_path}/{kind}"
        warc_salvage.write_archives(warc_salvage.records(pages.coalesce(1)), path, compression=kind)
        (file,) = (tmp_path / kind).glob("part-*")
        data = bytearray(file.read_bytes())
        whole = warc_salvage.read_archive(bytes(data))
        assert len(whole) == 300 and all(isinstance(x, warc_salvage.Record) for x in whole)
        hit = whole[30]
        data[hit.offset + hit.length // 2] ^= 0x55
        file.write_bytes(bytes(data))
        (tmp_path / kind / f".{file.name}.crc").unlink(missing_ok=True)
        got = warc_salvage.read_archives(spark, path).collect()
        gaps = [r for r in got if r.kind == "gap"]
        assert {int(r.record_id) for r in got if r.kind == "record"} == set(range(300)) - {int(hit.headers["warc-record-id"][10:-1])}
        assert [g.offset for g in gaps] == [hit.offset] and 0 <= gaps[0].length - hit.length <= len(warc_salvage.EMPTY_MEMBER)


def test_warc_repeated_rows_long_payloads_and_empty_tables(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "a", "x"), (None, None, "x"), (7, "v", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("k"))
    warc_salvage.write_archives(warc_salvage.records(pages), f"file://{tmp_path}/a", warc_salvage.records_per_file(pages, 1000))
    got = warc_salvage.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.record_id, r.uri, r.record_type, r.refers_to) for r in got) == [("", "", "revisit", "1"), ("1", "a", "response", None), ("1", "u", "revisit", "1"), ("1", "u", "revisit", "1"), ("7", "v", "response", None)]
    assert max(len(r.payload or b"") for r in got) == 3_000_000
    warc_salvage.write_archives(warc_salvage.records(pages.where("url = 'u'")), f"file://{tmp_path}/b")
    assert sorted(r.record_type for r in warc_salvage.read_archives(spark, f"file://{tmp_path}/b").collect()) == ["response", "revisit"]
    warc_salvage.write_archives(warc_salvage.records(pages.limit(0)), f"file://{tmp_path}/c")
    assert warc_salvage.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(8)}
    rows = [(i, [f - (1 << 64) if f >> 63 else f], 1) for i, f in enumerate(sorted(fps))]
    classes = spark.createDataFrame(rows, "rep long, fp array<long>, weight long")
    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and bin((x[0] ^ y[0]) & (1 << 64) - 1).count("1") <= 2}
    assert want and {tuple(r) for r in simhash_bytes.close_links(classes, 2).collect()} == want
    assert {tuple(r) for r in simhash_bytes.close_links(classes, 2, list_limit=2).collect()} == want  # all lists by changed bits


def test_fingerprint_by_definition():
    for text in ("One two  three\tFOUR five", "a b", "x", ""):
        w = text.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
        assert simhash_bytes.fingerprint(simhash_bytes.shingle_hashes(text, 3))[0] & (1 << 64) - 1 == want


def test_near_groups_edges(edges, empty):
    got = simhash_bytes.near_groups(edges).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash_bytes.near_groups(empty).count() == 0 and simhash_bytes.similar_groups(empty).count() == 0


def test_similar_groups_find_edited_copies(spark):
    text = prose(1, 300).split()
    edited = [*text[:100], "NEW", *text[101:]]
    rows = [(0, prose(9, 300)), *[(i, " ".join(edited if i % 2 else text)) for i in range(1, 8)], (20, prose(11, 300)), (21, None), (22, "")]
    got = dict(simhash_bytes.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), list_limit=3).collect())
    assert {got[i] for i in range(1, 8)} == {1} and got[0] == 0 and got[20] == 20 and got[22] == 21


def set_pairs(seed, n, shared, own):
    """Texts of numbered words, two by two with so many shared and own shingles of five words each: Jaccard shared / (shared + 2 own)."""
    out = []
    for i in range(n):
        words = [f"w{seed}x{i}x{k}" for k in range(shared + 4)]
        out += [(2 * i + j, " ".join(words + [f"o{seed}x{i}x{j}x{k}" for k in range(own)])) for j in range(2)]
    return out


def test_similar_groups_recall_at_the_limit(spark):
    rows = set_pairs(1, 300, 80, 10)
    assert simhash_bytes.jaccard(rows[0][1], rows[1][1], 5) == 0.8
    below = [(1000 + i, t) for i, t in set_pairs(2, 100, 79, 11)]
    got = dict(simhash_bytes.similar_groups(spark.createDataFrame(rows + below, "doc_id long, text string")).collect())
    assert sum(got[2 * i + 1] == 2 * i for i in range(300)) == 300
    assert all(got[i] == i for i, _ in below)


def test_similar_groups_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr("rankloom.llm.common.LIST_BLOCK", 16)
    common = prose(1, 104).split()  # 100 shingles that all share; 13 of each pair, 5 of each text: 0.74 across pairs, 0.92 within
    rows = [(2 * i + j, " ".join(common + [f"p{i}x{k}" for k in range(13)] + [f"o{i}x{j}x{k}" for k in range(5)])) for i in range(120) for j in range(2)]
    assert simhash_bytes.jaccard(rows[0][1], rows[2][1], 5) < 0.8 < simhash_bytes.jaccard(rows[0][1], rows[1][1], 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (3, 48):
        assert dict(simhash_bytes.similar_groups(df, list_limit=limit).collect()) == {i: i - i % 2 for i in range(240)}


def test_similar_groups_by_bytes_alone(spark, monkeypatch):
    """The index of positional bytes finds close copies without the bands."""
    monkeypatch.setattr(simhash_bytes, "band_keys", lambda least: np.empty(0, np.int64))
    rows = set_pairs(5, 60, 98, 1)
    assert simhash_bytes.jaccard(rows[0][1], rows[1][1], 5) == 0.98
    got = dict(simhash_bytes.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got[2 * i + 1] == 2 * i for i in range(60)) >= 54 and all(got[2 * i] == 2 * i for i in range(60))


def test_shared_bytes_are_counted(spark):
    h = np.random.default_rng(3).integers(0, 1 << 64, 300, np.uint64)
    assert simhash_bytes.set_fingerprint(h).tolist() == simhash_bytes.fingerprint(h, simhash_bytes.LANES)
    low, n = simhash_bytes.least_shared(0.8), 8 * simhash_bytes.LANES
    fps = {0: bytes(n), 1: bytes(low) + b"\1" * (n - low), 2: bytes(low - 1) + b"\1" * (n - low + 1), 3: bytes(low) + b"\xff" * (n - low)}
    classes = spark.createDataFrame([(i, bytearray(f)) for i, f in fps.items()], "node long, fp binary")
    pairs = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "a long, b long")
    assert [tuple(r) for r in simhash_bytes._counted(pairs, classes, 0.8).collect()] == [(0, 1)]


def test_bit_sets_are_joined_once(spark):
    lists = spark.createDataFrame([(0, 1, i, i // 2) for i in range(6)], "slot int, key long, node long, component long")
    bits = spark.createDataFrame([(i, 3, bytearray(common.bits_of(np.array([1, 2, 3 + i // 3], np.uint64)).tobytes())) for i in range(6)], "node long, size int, bits binary")
    near = common.near_in_lists(lists, bits, 0.8, best=False)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, (node") == 1
    assert sorted(map(tuple, near.collect())) == [(0, 2), (1, 2), (3, 4), (3, 5)]


def test_similar_groups_take_listed_texts_once(spark, monkeypatch):
    """Later steps read the staged texts of the lists, never the input: its texts go through the network once, and nothing big stays."""
    names, dropped, plain, drop = [], set(), simhash_bytes.staged, common.drop_staged

    def staged(df, name):
        source = "input_text" in df._jdf.queryExecution().optimizedPlan().toString()
        names.append((name, source))
        return plain(df, name)

    monkeypatch.setattr(simhash_bytes, "staged", staged)
    monkeypatch.setattr(simhash_bytes, "drop_staged", lambda *frames: (dropped.update(f._staged_path.rsplit("-", 1)[1] for f in frames), drop(*frames)), raising=False)
    base = prose(1, 120).split()
    rows = [(i, " ".join([*base[: 5 * i], "x", *base[5 * i + 1 :]])) for i in range(12)] + [(20, prose(2, 90)), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, input_text string").select("doc_id", F.concat("input_text", F.lit(" ")).alias("text"))
    got = {r.doc_id: r.component_id for r in simhash_bytes.similar_groups(docs).collect()}
    assert {got[i] for i in range(12)} == {0} and (got[20], got[21]) == (20, 21)
    assert [n for n, source in names if source] == ["sets", "texts"] and {"sets", "classes", "postings", "texts"} <= dropped


def test_similar_groups_compare_sets(spark):
    line = " ".join(f"l{k}" for k in range(9))
    words = " ".join(f"a{k}" for k in range(100))
    docs = [(i, f"{line} " * 60 + " ".join(f"z{i}x{k}" for k in range(40))) for i in range(2)] + [(10, f"{words} " + f"{line} " * 40), (11, f"{words} " + f"{line} " * 2)]
    assert simhash_bytes.jaccard(docs[0][1], docs[1][1], 5) < 0.2 and simhash_bytes.jaccard(docs[2][1], docs[3][1], 5) == 1
    docs += [(20, "x y z " * 30), (20, " ".join(f"q{k}" for k in range(60))), (21, " ".join(f"q{k}" for k in range(61)))]  # an id with two texts
    got = sorted(map(tuple, simhash_bytes.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(0, 0), (1, 1), (10, 10), (11, 10), (20, 20), (20, 20), (21, 20)]


def test_decontamination_equals_sql(spark, edges, empty):
    want = duckdb.sql(queries.ORACLE_SQL["op10_decontaminate"].replace("from documents", f"from '{SF}/documents.parquet'").replace("from benchmark", f"from '{SF}/benchmark.parquet'")).df()
    got = queries.op10_decontaminate(spark, SF).toPandas()
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy()))
    assert key(got) == key(want)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(edges, bench).collect()}
    assert rows[8].n_hit == 1 and rows[1].n_words == 0 and decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edges, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_parts_and_offsets(spark, edges, empty):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(str, df.collect()))
    whole = decontaminate.contamination(docs, bench)
    assert key(decontaminate.contamination(docs, bench, most=2000)) == key(whole)  # several automata, one after another
    assert decontaminate.contamination(edges, bench, most=2000).count() == len(EDGES) and decontaminate.contamination(empty, bench, most=2000).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for r in whole.where("n_hit > 0").collect():
        assert r.n_hit == sum(s.end_word - s.start_word for s in r.hit_spans)
        for s in r.hit_spans:
            assert decontaminate.norm_words(texts[r.doc_id][s.start : s.end]) == decontaminate.norm_words(texts[r.doc_id])[s.start_word : s.end_word]
            seen += 1
    assert seen > 0


def test_mix_laws(spark, edges, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = budget_mix.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(per.taken - per.target) <= np.maximum(50, 0.02 * per.target)).all() and abs(per.target.sum() - 1.5 * per.source_size.sum()) < 1e-6 * per.target.sum()
    assert sorted(map(tuple, got[["doc_id", "taken"]].to_numpy())) == sorted(map(tuple, budget_mix.mix(docs).toPandas()[["doc_id", "taken"]].to_numpy()))
    assert budget_mix.mix(edges).count() == len(EDGES) and budget_mix.mix(empty).count() == 0


def test_knapsack_is_exact():
    r = random.Random(2)
    for _ in range(30):
        lengths, counts, budget = np.array(sorted(r.sample(range(1, 30), 5))), np.array([r.randrange(4) for _ in range(5)]), r.randrange(80)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        use = budget_mix.knapsack(lengths, counts, budget)
        assert (use <= counts).all() and int((use * lengths).sum()) == max(s for s in sums if s <= budget)


def test_shards_are_even_and_whole(spark, edges, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = kd_shards.shard(docs, 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and len(size) == 8 and size.max() < 1.02 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert kd_shards.shard(edges, 3).count() == len(EDGES) and kd_shards.shard(empty, 3).count() == 0


def test_tree_splits_like_a_plain_one(spark):
    rng = np.random.default_rng(7)
    x = rng.random((400, 3)) * [1, 0.6, 0.3]
    w = rng.integers(1, 50, 400)
    df = spark.createDataFrame([(i, int(w[i]), *map(float, x[i])) for i in range(400)], "g long, w long, x0 double, x1 double, x2 double")
    got = {}
    for r in kd_shards._tree(df, [1.0] * 5).collect():
        got.setdefault(r.node, set()).add(r.g)

    def split(rows, leaves):
        if len(leaves) == 1:
            return {leaves[0]: set(map(int, rows))}
        d = int(np.ptp(x[rows], axis=0).argmax())
        rows = rows[np.argsort(x[rows, d])]
        want = w[rows].sum() * (len(leaves) // 2) / len(leaves)
        sums = np.concatenate(([0], np.cumsum(w[rows])))
        cut = int(np.abs(sums - want).argmin())
        return split(rows[:cut], leaves[: len(leaves) // 2]) | split(rows[cut:], leaves[len(leaves) // 2 :])

    assert got == split(np.arange(400), list(range(5)))


def test_leaves_are_evened():
    moves = kd_shards.evened([100.0, 40.0, 70.0], [(1, 30.0, 0), (2, 5.0, 0), (3, 65.0, 0), (4, 40.0, 1), (5, 70.0, 2)], 70.0)
    assert moves == {1: 1}
    assert kd_shards.evened([90.0, 70.0], [(1, 90.0, 0), (2, 70.0, 1)], 80.0) == {} and kd_shards.evened([], [], 1.0) == {}
    rng = np.random.default_rng(3)
    items = [(i, float(rng.integers(3, 60)), int(rng.integers(8))) for i in range(120)]
    load = [sum(w for _, w, s in items if s == k) for k in range(8)]
    at = kd_shards.evened(load, items, sum(load) / 8)
    after = [sum(w for i, w, s in items if at.get(i, s) == k) for k in range(8)]
    assert sum(after) == sum(load) and max(after) - min(after) <= 2 and len(at) < 100


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0, 0.05, 0.12, 0.2)] + [base[:3] * 2])
    rows = [(i, [float(x) for x in e], int(i % 40 % 3)) for i, e in enumerate(v)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None], 1), (504, [1.0] * 16, None), (505, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in multi_index.near_vectors(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[: len(v)]])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(v), dtype=bool)
    assert [got[i].n_links for i in range(len(v))] == link.sum(1).tolist() and link.sum() > 20
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(link, root[None], len(v)).min(1))
    assert [got[i].component_id for i in range(len(v))] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506)) and multi_index.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_radius_beside_a_hot_group(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 16))
    hot = rng.standard_normal(16) + 1e-6 * rng.standard_normal((1500, 16))
    v = np.concatenate([base, base + 0.15 * rng.standard_normal(base.shape), hot])
    got = {r.vec_id: r.n_links for r in multi_index.near_vectors(spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98).sum(axis=1) - 1)[:3000]
    found = np.array([got[i] for i in range(3000)])
    assert want.sum() > 1000 and (found <= want).all() and found.sum() >= 0.995 * want.sum()


def test_fuzzy_lines(spark, edges, empty):
    line = prose(1, 30)
    docs = [(1, f"{line}\n\nother words entirely here"), (2, line + " x"), (3, line.replace(line.split()[3], "changed")), (4, line), *[(10 + i, f"{line} {i}") for i in range(6)]]
    got = {(r.doc_id, r.line_no): r for r in line_minhash.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len({got[(i, 0)].component_id for i, _ in docs}) == 1 and [k for k, r in got.items() if r.kept] == [k for k in got if k in ((1, 0), (1, 1), (1, 2))]
    assert got[(1, 1)].component_id is None and got[(4, 0)].n_copies == 2
    assert line_minhash.dedup_lines(edges).count() == sum(len(t.split("\n")) for _, t in EDGES if t is not None) and line_minhash.dedup_lines(empty).count() == 0


def test_fuzzy_lines_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in line_minhash.dedup_lines(docs).where("line_id is not null").select("line_id", "component_id").distinct().collect():
        got.setdefault(r.component_id, set()).add(r.line_id)
    lines = sorted({line_minhash.normal(x) for r in docs.collect() if r.text is not None for x in r.text.split("\n")} - {""})
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    at = {}
    cells = [(i, at.setdefault(s, len(at))) for i, ss in enumerate(sets) for s in ss]
    m = np.zeros((len(lines), len(at)), np.float32)
    m[tuple(np.array(cells).T)] = 1
    both, n = m @ m.T, m.sum(axis=1)
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in np.argwhere(both / (n[:, None] + n - both) >= 0.8 - 1e-6):
        root[find(a)] = find(b)
    want = {}
    for i, x in enumerate(lines):
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        want.setdefault(find(i), set()).add(h - (1 << 64) if h >> 63 else h)
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values())) and len(want) < len(lines)
    assert all(k == min(v) for k, v in got.items())


def test_fuzzy_lines_free_their_steps(spark, monkeypatch):
    half = prose(1, 14)
    docs = spark.createDataFrame([(i, f"{half} {prose(50 + i // 2, 5)}{' x' * (i % 2)}") for i in range(60)], "doc_id long, text string")
    want = {(r.doc_id, r.component_id) for r in line_minhash.dedup_lines(docs, list_limit=4).collect()}
    made, lines, real = [], [], line_minhash.staged

    def staged(df, name, *args, **kw):
        made.append((name, sorted(n for n, f in lines if Path(f._staged_path.removeprefix("file://")).exists())))
        out = real(df, name, *args, **kw)
        lines.append((name, out))
        return out

    monkeypatch.setattr(line_minhash, "staged", staged)
    monkeypatch.setattr(line_minhash, "ROUND_ROWS", 1)
    assert {(r.doc_id, r.component_id) for r in line_minhash.dedup_lines(docs, list_limit=4).collect()} == want and len({c for _, c in want}) == 30
    near = [held for name, held in made if name == "near"]
    assert len(near) == 2 * line_minhash.ROUNDS  # each round's shuffle files go with it
    assert near[0].count("open") == 1 and "lists" in near[0] and near[-1].count("open") == 1 and "lists" not in near[-1]


def test_repeated_passages(spark, edges, empty):
    passage = prose(1, 70).split()
    fuzzy = [*passage[:30], "NEW", *passage[31:50], *passage[52:]]
    docs = [(1, prose(2, 100) + " " + " ".join(passage)), (2, " ".join(fuzzy).upper() + " " + prose(3, 50)), (3, prose(4, 200)), (4, prose(4, 200)), (5, prose(6, 90)), *[(10 + i, f"{prose(100 + i, 20)} {' '.join(passage)} {prose(200 + i, 9)}") for i in range(12)]]
    got = {r.doc_id: r for r in chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].cut_words == 0 and got[1].repeat_words >= 68 and got[2].component_id == 1 and 60 <= got[2].cut_words <= 72
    assert all(got[10 + i].component_id == 1 and got[10 + i].cuts[0].repeats == 1 and got[10 + i].cuts[0].start == 20 and got[10 + i].cuts[0].end == 90 for i in range(12))
    assert got[4].cut_words == 200 and got[3].cut_words == 0 and got[5].repeat_words == 0 and got[5].component_id == 5
    rows = chain_dedup.repeated_passages(edges).collect()
    assert len(rows) == len(EDGES) and sorted(r.cut_words for r in rows if r.doc_id in (5, 6)) == [0, 80, 80]
    assert chain_dedup.repeated_passages(empty).count() == 0


def test_passages_are_extended_across_edits(spark):
    passage = [f"p{k}" for k in range(60)]
    edited = [w if k not in (12, 48) else "NEW" for k, w in enumerate(passage)]
    got = chain_dedup.align([*"uvw", *passage, "x"], ["y", *edited, *"zq"], [(16, 14, 20)], 2)
    assert got == (3, 63, 1, 61, 2)
    docs = [(0, f"{prose(1, 50)} {' '.join(passage)} {prose(2, 50)}"), (1, f"{prose(3, 50)} {' '.join(edited)} {prose(4, 50)}")]
    rows = {r.doc_id: r for r in chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].component_id == 0 and [(c.start, c.end) for c in rows[1].cuts] == [(50, 110)]


def test_extensions_of_many_pairs_equal_single_ones():
    rng, pairs = random.Random(12), [([], ["x"]), (["x"], []), ([], [])]
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(61))]
        b = [w if rng.random() > 0.15 else rng.choice("abcxyz") for w in a for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 2)))][:60]
        pairs.append((a, b if rng.random() < 0.8 else b[:7]))
    for cost in (chain_dedup.COST, chain_dedup.CHEAP, 4):
        assert chain_dedup.extended_all(pairs, cost) == [chain_dedup.extended(a, b, cost) for a, b in pairs]
    assert all(chain_dedup.equal_words(a, b) == sum((Counter(a) & Counter(b)).values()) for a, b in pairs)
    assert chain_dedup.segments(np.array([5]), np.array([9])) == [(5, 9, chain_dedup.SEED)]
    assert chain_dedup.extended_all([], 2) == [] and chain_dedup.chains([(3, 4, 6)], 1) == [[(3, 4, 6)]] and chain_dedup.chains([(3, 4, 6)], 7) == []


def test_fuzzy_passages_are_found(spark):
    """Passages of 45, 60 and 100 words with the share of words replaced, 60 each, in random contexts; their first and last word stay."""
    rng, docs, planted = random.Random(8), [], {}
    word = lambda: f"w{rng.randrange(200000)}"
    for n in (45, 60, 100):
        for identity in (0.82, 0.85, 0.9, 0.95):
            for _ in range(60):
                p = [word() for _ in range(n)]
                edited = set(rng.sample(range(1, n - 1), int(n * (1 - identity))))
                i = len(docs)
                for text in (p, [word() if k in edited else x for k, x in enumerate(p)]):
                    docs.append((len(docs), " ".join([word() for _ in range(80)] + text + [word() for _ in range(80)])))
                planted.setdefault((n, identity), []).append(i + 1)
    got = {r.doc_id: r for r in chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {k: np.mean([got[i].component_id == i - 1 and 0.65 * k[0] <= got[i].cut_words <= k[0] + 8 for i in ids]) for k, ids in planted.items()}
    assert min(found.values()) >= 0.9, found


def test_long_lists_of_a_seed_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(chain_dedup, "LIST_PART", 8)
    passage = prose(1, 60)
    docs = [(i, f"{prose(1000 + i, 30)} {passage} {prose(2000 + i, 30)}") for i in range(60)]
    got = chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and all((r.cut_words >= 60) == (r.doc_id > 0) and r.repeat_words >= 60 for r in got)


def test_halves_that_many_texts_have_hide_no_passage(spark):
    docs = []
    for k in range(24):
        half, at = [prose(5000 + 2 * k, 24), prose(5001 + 2 * k, 24)], 100 * k
        for i in range(44):
            own = " ".join(half) if i in (20, 40) else half[i % 2]
            docs.append((at + i, f"{prose(10000 + at + i, 40)} {own} {prose(20000 + at + i, 40)}"))
    got = {r.doc_id: r for r in chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for at in range(0, 2400, 100):
        one, two = got[at + 20], got[at + 40]
        assert two.component_id == one.component_id and min(one.repeat_words, two.repeat_words) >= 48
        assert any(c.start <= 40 and c.end >= 88 for c in two.cuts)


def test_equal_runs_equal_brute_force(spark, monkeypatch):
    """Texts of phrases that many have: every word in 40 equal words of another text counts, and is cut if that is an earlier one."""
    monkeypatch.setattr(chain_dedup, "ALL_PAIRS", 4, raising=False)
    rng = random.Random(3)
    phrases = [prose(300 + i, rng.randrange(14, 34)) for i in range(9)]
    docs = [(i, " ".join([prose(1000 + i, 9), *[rng.choice(phrases) for _ in range(rng.randrange(1, 6))], prose(2000 + i, 7)])) for i in range(90)]
    first, texts = {}, {}
    for i, text in docs:
        w = text.split()
        for k in range(len(w) - 39):
            texts.setdefault(tuple(w[k : k + 40]), set()).add(i)
            first.setdefault(tuple(w[k : k + 40]), i)
    got = {r.doc_id: r for r in chain_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    inside = 0
    for i, text in docs:
        w = text.split()
        at = {k: tuple(w[k : k + 40]) for k in range(len(w) - 39)}
        shared = {x for k, g in at.items() if len(texts[g]) > 1 for x in range(k, k + 40)}
        later = {x for k, g in at.items() if first[g] < i for x in range(k, k + 40)}
        assert got[i].repeat_words >= len(shared) and later <= {x for c in got[i].cuts for x in range(c.start, c.end)}
        assert all(got[i].component_id == got[j].component_id for g in at.values() for j in texts[g])
        inside += len(shared)
    assert inside > 1000


def test_equal_words_of_many_windows():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aAbBcde\u00c9\u00e9") for _ in range(rng.randrange(60))) for _ in range(200)]
    codes, cut = chain_dedup.word_codes(pa.array(texts))
    n, start = np.diff(cut), cut[:-1]
    fold = [t.translate(str.maketrans("ABCDE", "abcde")).split(" ") for t in texts]
    assert chain_dedup.equal_counts(codes, start[:100], n[:100], start[100:], n[100:]).tolist() == [chain_dedup.equal_words(a, b) for a, b in zip(fold[:100], fold[100:], strict=True)]
    assert chain_dedup.equal_counts(codes, start[:0], n[:0], start[:0], n[:0]).tolist() == []


def test_chain_prefers_order_over_crossing():
    best = chain_dedup.chains([(0, 0, 20), (25, 24, 20), (10, 90, 6), (50, 48, 20)], 10)
    assert best[0] == [(0, 0, 20), (25, 24, 20), (50, 48, 20)]
    assert chain_dedup.edits(list("kitten"), list("sitting")) == 3 and chain_dedup.edits([], ["a"]) == 1


def test_toxicity_held_out_accuracy(spark, edges, empty):
    rng = random.Random(4)
    docs = [(i, prose(i, 60) + (" vile" + str(rng.randrange(5)) + " " if i % 3 == 0 else "") + prose(i + 9000, 20), "en") for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxic_cnn.fit(df, labels)
    got = toxic_cnn.score(df, model).where("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == (got.doc_id % 3 == 0)).mean() > 0.95
    out = toxic_cnn.score(edges, model).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out) and toxic_cnn.score(empty, model).count() == 0
    assert len(toxic_cnn.fit(df.limit(0), labels.limit(0)).emb) == toxic_cnn.BUCKETS


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    """Beyond the training sample's bounds in rows and words, too."""
    monkeypatch.setattr(toxic_cnn, "MAX_ROWS", 20)
    monkeypatch.setattr(toxic_cnn, "MAX_WORDS", 70)
    rng, seen = random.Random(6), []
    rows = [(i, prose(i, 30 + i % 60) + (" vile" + str(rng.randrange(5)) if i % 3 == 0 else ""), ["en", "de"][i % 2]) for i in range(600)]
    calibrate = toxic_cnn.calibrate
    monkeypatch.setattr(toxic_cnn, "calibrate", lambda s, y, langs: (seen.append(sorted(zip(y, langs, strict=True))), calibrate(s, y, langs))[1])
    model = toxic_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int"))
    tune = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert seen == [sorted((float(i % 3 == 0), ["en", "de"][i % 2]) for i in tune)] * 2
    scores = toxic_cnn.score_ids(model, [toxic_cnn.word_ids(rows[i][1]) for i in tune])
    again = calibrate(scores, np.array([float(i % 3 == 0) for i in tune]), [rows[i][2] for i in tune])
    assert again.keys() == model.thresholds.keys() and all(abs(again[k] - v) < 1e-4 for k, v in model.thresholds.items())


def test_long_texts_score_whole():
    m = toxic_cnn.train([np.arange(1, 9, dtype=np.int32)] * 4, np.array([1, 0, 1, 0], np.float32), epochs=1)
    ids = (np.arange(3 * toxic_cnn.PIECE + 5) % 1000 + 1).astype(np.int32)
    flat, starts = toxic_cnn._pad([ids])
    want = 1 / (1 + np.exp(-toxic_cnn._logit(m, np.maximum.reduceat(toxic_cnn._windows(m, flat), starts, axis=0))))
    assert abs(toxic_cnn.score_ids(m, [ids])[0] - want[0]) < 1e-5


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("row", F.lit("r"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
    dup = docs.unionByName(docs)
    assert corpus_pipeline.near_duplicates(spark, dup, SF).count() == corpus_pipeline.near_duplicates(spark, docs, SF).count()


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # near duplicates: every pair compared, components by repeated minima
    sets, root = {i: shingle_set(r.text) for i, r in rows.items()}, {i: i for i in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert links and sorted(r.doc_id for r in near) == sorted(i for i in root if root[i] == i)
    # decontamination: windows of 13 words as plain strings
    bench = [decontaminate.norm_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in bench for i in range(max(1, len(w) - 12)) if w}

    def clean(text):
        w = decontaminate.norm_words(text)
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        run = max((len(x) for x in "".join("x" if h else " " for h in hit).split()), default=0)
        return run < 13 and not (any(hit) and 20 * sum(hit) >= len(w))

    got = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).select("doc_id").collect()}
    assert got == {i for i, r in rows.items() if clean(r.text)} and len(got) < len(rows)
    # toxicity: scores by the model on the driver against the threshold of the language
    model = toxic_cnn.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(rows, toxic_cnn.score_ids(model, [toxic_cnn.word_ids(r.text) for r in rows.values()]), strict=True))
    left = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SF).select("doc_id").collect()}
    unsure = {i for i, r in rows.items() if abs(score[i] - model.thresholds.get(r.lang, model.thresholds.get(None, 0.5))) < 1e-5}
    assert left - unsure == {i for i, r in rows.items() if score[i] < model.thresholds.get(r.lang, model.thresholds.get(None, 0.5))} - unsure
    # mixture: each row as often as its words were taken
    taken = {r.doc_id: r.taken // max(r["size"], 1) for r in budget_mix.mix(docs).collect()}
    mixed = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, SF).select("doc_id").collect()]
    assert all(mixed.count(i) == n for i, n in taken.items() if len((rows[i].text or "").split()))
    # sharding: every row once, slots without gaps, shards of near equal bytes but for a group larger than one
    out = corpus_pipeline.sharding(spark, docs, SF).toPandas()
    assert sorted(out.doc_id) == sorted(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert dict(zip(out.doc_id, out["size"], strict=True)) == {i: len((r.text or "").encode()) + 16 for i, r in rows.items()}


def test_pipeline_stages_at_the_edges(spark, edges):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, SF).collect()
        ids = {r.doc_id for r in out}
        assert 8 in ids or name == "mixture", name
        if name == "toxicity":
            assert len(out) <= len(EDGES)
        if name == "near_duplicates":
            assert ids == {1, 4, 5, 8, 9, None} and len(out) == 6
        if name == "decontamination":
            assert len(out) == len(EDGES)
        if name == "sharding":
            assert len(out) == len(EDGES)


def test_pipeline_tells_rows_without_id_apart(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    texts = [prose(300 + i, 50 + i) for i in range(6)]
    docs = spark.createDataFrame([(None, t, "en", "s") for t in [*texts, texts[0], item]] + [(1, prose(1, 60), "en", "s"), (1, item, "en", "s")], "doc_id long, text string, lang string, source string")
    seen = lambda df: sorted(r.text for r in df.collect())
    near = seen(corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), SF))
    assert near == sorted([*texts, item])
    assert seen(corpus_pipeline.decontamination(spark, docs, SF)) == sorted([*texts, texts[0], prose(1, 60)])
    clean = docs.where("doc_id is null").limit(6)
    taken = {r.doc_id: r.times for r in budget_mix.mix(clean.withColumn("doc_id", F.xxhash64("text"))).collect()}
    got = seen(corpus_pipeline.mixture(spark, clean, SF))
    assert len(got) == sum(taken.values()) and set(got) == set(texts) and max(map(got.count, got)) <= 2


def test_sha1_and_base32():
    assert warc_salvage.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_near_vectors_go_in_rounds_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 12)).astype(np.float32)
    v = np.concatenate([base, base + 0.1 * rng.standard_normal(base.shape).astype(np.float32)])
    df = spark.createDataFrame([(i, [float(x) for x in e], i % 2) for i, e in enumerate(v)], "vec_id long, embedding array<float>, label int")
    want = {tuple(r) for r in multi_index.near_vectors(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()}
    monkeypatch.setattr(multi_index, "SENT", 1)
    kept = []
    monkeypatch.setattr(multi_index, "staged", lambda df, name, real=multi_index.staged: kept.append((name, df.schema.simpleString())) or real(df, name))
    assert {tuple(r) for r in multi_index.near_vectors(df).collect()} == want and sum(r[1] for r in want) > 40
    assert [n for n, _ in kept].count("links") > 1 and all("array<double>" not in s for _, s in kept)
