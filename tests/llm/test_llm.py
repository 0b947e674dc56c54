"""Every operator against its brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import io
import pathlib
import random
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(pathlib.Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusloom.llm import license_scan, queries as Q, warc  # noqa: E402
from corpusloom.llm.components import connected_components  # noqa: E402
from corpusloom.llm.cuckoo import CuckooFilter, split_keys  # noqa: E402
from corpusloom.llm.decontaminate import WinnowSpec, contamination  # noqa: E402
from corpusloom.llm.license_rules import license_rules  # noqa: E402
from corpusloom.llm.near_copies import near_copies  # noqa: E402
from corpusloom.llm.line_dedup import LineIndex, LineSpec, dedup_lines  # noqa: E402
from corpusloom.llm.packing import PackSpec, cuts, match_brackets, meetings, pack_documents, place  # noqa: E402
from corpusloom.llm.quality_classifier import ClassifierSpec, classify  # noqa: E402
from corpusloom.llm.quality_rules import judge  # noqa: E402
from corpusloom.llm.simhash import SimHashSpec, near_duplicates  # noqa: E402
from corpusloom.llm.token_store import TokenStoreSpec, read_tokens, write_tokens  # noqa: E402
from corpusloom.llm.url_filter import FilterSpec, Rule, filter_urls  # noqa: E402
from corpusloom.llm.vocab import BYTE_BPE, WORD_BPE, Encoder, vocabulary_path  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD_WORDS = ["the", "Of", "rain", "é", "ß,", "x.", "CC", "by", "license", "Line", "日本", "a|b", "#", "…", "it's", "4.5", "<|endoftext|>", "\u00a0", "Σ"]


def odd_texts(seed=3, n=40):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(ODD_WORDS) for _ in range(rnd.randint(0, 14)))
    fixed = ["A common line that many documents share here", "  a COMMON line that many documents share here\t"]
    out = ["\n".join(rnd.choice([line(), line(), rnd.choice(fixed)]) for _ in range(rnd.randint(0, 6))) for _ in range(n)]
    return [None, "", " ", "\n\n", "word", "\x00\x1c \x0b", " lead", "trail ", *out, out[5], out[5], "very long " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with a null id, repeated rows and columns of clashing names; and the same as a list."""
    rows = [(k if k != 9 else None, t) for k, t in enumerate(odd_texts())]
    rows += [rows[12], rows[12], (3, "the same id again")]
    wide = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, 2, "x", "y", 0.5) for i, t in rows]
    frame = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, fp int, words string, key string, score double").repartition(5)
    return frame, rows


@pytest.fixture(scope="module")
def empty(odd):
    return odd[0].limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(spark):
    return [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]


# 1. URL filter


def test_url_rules(spark):
    urls = [
        (1, "http://a.example.com/en/7x"), (2, "https://EXAMPLE.com/en/6"), (3, "http://x.net/de/"), (4, "http://example.net/de/8?x"), (5, "ftp://o.org/es/1#f"), (6, None), (7, "no scheme"), (8, "http://notexample.com/en/7"), (8, "http://notexample.com/en/7"),
        (9, "http://host.org"), (10, "http://Www.Listed.org/a/index.html?utm_source=x&b=2&a=1#q"), (None, "http://listed.org:80/a?a=1&b=2"), (11, "http://listed.org/a?a=1"), (12, "://"), (13, ""), (14, "http://com/en/"), (15, "a://b://c/d"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in urls], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://listed.org/a?b=2&a=1",), ("https://listed.org/a/?a=1&b=2",), (None,), ("bad",)], "url string")
    for spec in (FilterSpec(), FilterSpec(broadcast_bytes=0), FilterSpec(bits_per_key=1)):
        got = collections.defaultdict(list)
        for r in filter_urls(pages, listed, Q.URL_RULES, spec).collect():
            got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
        assert sum(map(len, got.values())) == len(urls) and len(got[8]) == 2
        assert got[1] == [("a.example.com", "/en/7x", "example.com/en/7", "allow")] and got[2][0][2:] == ("com/en/", "block")
        assert got[3][0][2:] == ("net/de/", "allow") and got[4] == [("example.net", "/de/8", "example.net/de/8", "block")]
        assert got[5][0] == ("o.org", "/es/1", "org/es/", "block") and got[6] == got[7] == [("", "", None, "allow")]
        assert got[8][0][2:] == ("com/en/", "block") and got[9] == [("host.org", "", None, "allow")]
        assert got[10][0][2:] == got[None][0][2:] == (None, "block") and got[11][0][3] == "allow" and got[14][0][2] == "com/en/"
        assert got[15][0][:2] == ("b:", "//c/d")
    assert filter_urls(pages.limit(0), listed, Q.URL_RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_has_no_false_negative_and_few_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    found = filter_urls(pages, listed, []).agg(F.count_if("listed").alias("l"), F.count_if("possible").alias("p"), F.count_if(F.col("listed") & ~F.col("possible")).alias("bad")).first()
    assert found["l"] == 3000 and found["bad"] == 0 and found["p"] < 3300


# 2. SimHash


def check_components(found, rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(prints, 4)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = collections.Counter((i, p, least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want


@pytest.mark.parametrize("split_at", [50_000, 2])
def test_simhash(spark, odd, split_at):
    check_components(near_duplicates(odd[0], SimHashSpec(split_at=split_at)).collect(), odd[1])
    check_components(near_duplicates(documents(spark), SimHashSpec(split_at=split_at)).collect(), pairs(spark))


def test_simhash_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_simhash_query(spark):
    found = Q.op2_simhash(spark, SF).collect()
    want = {i: f"{brute.fingerprint(t):016x}" for i, t in pairs(spark)}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == want


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(1, 1), (None, 4)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}


# 3. Quality rules


def test_quality_rules(spark, odd, empty):
    found = judge(odd[0]).collect()
    want = collections.Counter((i, *brute.rule_statistics(t)) for i, t in odd[1])
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in found)
    assert judge(odd[0], only_kept=True).columns == odd[0].columns and judge(empty).count() == 0
    assert judge(odd[0].drop("lang")).count() == len(odd[1])


def test_fertility_bands(spark):
    clean = (
        "Ordinary sentences with many different words describe how rivers carry rain from mountains towards distant quiet seas while birds follow their own paths above. "
        "Later a farmer opens the old gate, counts every sheep twice and walks home along narrow lanes before night falls; nobody waits there, yet lamps burn in two windows."
    )
    emoji = " ".join(chr(0x1F300 + 7 * k) + chr(0x1F680 + k) for k in range(60))
    rows = spark.createDataFrame([(1, clean, "en"), (2, emoji, "en"), (3, emoji, None), (4, " ".join("qz7" + str(k) + "xw9" * 3 for k in range(60)), "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in judge(rows).collect()}
    assert found[1]["kept"] and not found[2]["kept"] and found[2]["fallback_share"] > 0.5 and not found[4]["kept"]


def test_clean_documents_stay(spark):
    labelled = judge(documents(spark)).join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").filter("not base_failed")
    assert labelled.filter("not kept").count() == 0


# 4. Quality classifier


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).cache()
    held = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((held["score"] >= 0.7) == (held["quality"] == 1)).mean() > 0.95 and len(held) > 50
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


def test_classifier_takes_no_held_out_label(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    other = labels.withColumn("quality", F.when(fold == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(classify(docs, labels).collect()) == sorted(classify(docs, other).collect())


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (10, 0, 0), (None, 1, 0), (11, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    found = classify(odd[0], labels, ClassifierSpec(rounds=20))
    assert found.count() == len(odd[1]) and found.filter("score is null or held_out is null").count() == 0
    assert {r["score"] for r in classify(odd[0], labels.limit(0)).collect()} == {0.5}
    assert classify(empty, labels).count() == 0


# 5. License scan


def test_license_scan(spark, odd, empty):
    extra = [
        (100, "CC BY"), (101, "cc by cc by-nc 4.0 MIT License, mit license"), (102, "All rights reserved. Copyright 2020 X all rights reserved"), (103, "SPDX-License-Identifier: Apache-2.0 under the Apache License, Version 2.0"),
        (104, "This work is licensed under the GNU General Public License, version 3 or so"), (105, "ACC BY cc byte"), (106, "cc by " * 2000), (101, "cc by cc by-nc 4.0 MIT License, mit license"),
    ]
    frame = odd[0].select("doc_id", "text", "words").unionByName(spark.createDataFrame([(i, t, "w") for i, t in extra], "doc_id long, text string, words string"))
    rules = license_rules()
    assert len(rules) > 200
    want = collections.Counter()
    for i, t in odd[1] + extra:
        n, k, a, b, base, labels = brute.licenses(t, rules, license_scan.BASE)
        want[i, n, k, a, b, ",".join(base), ",".join(labels)] += 1
    found = license_scan.scan_licenses(frame).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"])) for r in found) == want
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in found)
    assert license_scan.scan_licenses(empty).count() == 0
    assert license_scan.scan_licenses(frame, []).count() == len(odd[1]) + len(extra)


# 6. WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é\r\nx", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "same" * 500), (9, "v", "same" * 500), (9, "v", "same" * 500), (None, "w", "same" * 500), (7, "z", "big" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    for spec in (warc.WarcSpec(), warc.WarcSpec(file_bytes=2000, sample_bytes=500), warc.WarcSpec(broadcast_rows=0)):
        found = warc.read_archives(spark, warc.write_archives(pages, spec=spec)).collect()
        heads = {b"": 3, b"same" * 500: 9}
        want = collections.Counter()
        for i, _, h in rows:
            data = (h or "").encode()
            head = heads.get(data, i)
            want[i, len(data), brute.base32_sha1(data), "response" if head == i else "revisit", None if head == i else head] += 1
        assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want
        assert all(bytes(r["payload"]) == b"" or brute.base32_sha1(bytes(r["payload"])) == r["payload_digest"] for r in found)
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def archive():
    records = [warc.build_record(k, "http://h/", b"<p>page %d</p>" % k * 20, None, "2026-01-01T00:00:00Z") for k in range(200)]
    trained = warc.train(records, 4096)
    packer = warc.zstandard.ZstdCompressor(dict_data=trained)
    return warc.dictionary_frame(trained.as_bytes()), [packer.compress(r) for r in records]


def test_archive_is_checked():
    head, frames = archive()
    assert head[:4] == (0x184D2A5D).to_bytes(4, "little")
    whole = head + b"".join(frames)
    assert len(list(warc.read_records(io.BytesIO(whole), chunk=37))) == 200
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(head[:20])))
    with pytest.raises((ValueError, warc.zstandard.ZstdError)):
        list(warc.read_records(io.BytesIO(b"".join(frames))))
    good = warc.build_record(1, "u", b"payload", None, "d")
    for bad in (good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"payload", b"paylord"), good[:-1], good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# 7. Line dedup


@pytest.mark.parametrize("limit", [64 << 20, 3000, 0])
def test_line_dedup(spark, odd, empty, limit):
    spec = LineSpec(broadcast_bytes=limit, keys_per_shard=4, lines_per_task=20)
    found = dedup_lines(odd[0], spec)
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == collections.Counter(brute.line_dedup(odd[1]))
    assert set(odd[0].columns) - {"n_lines"} <= set(found.columns) and dedup_lines(empty, spec).count() == 0
    got = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(documents(spark), spec).collect())
    assert got == collections.Counter(brute.line_dedup(pairs(spark)))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup_tells_documents_apart_by_id(spark, limit):
    """A line in two documents stays, however many rows repeat one of them; in three it goes, also where a row has no id."""
    twice, thrice = "a line that two documents hold, one of them twice", "a line that three documents hold, and one row more"
    rows = [(1, f"{twice}\n{thrice}"), (1, f"{twice}\n{thrice}"), (2, f"{twice}\n{thrice}"), (3, thrice), (None, thrice), (None, twice)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone_keys string, _gone_keys int")
    found = dedup_lines(docs, LineSpec(broadcast_bytes=limit))
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()) == collections.Counter(brute.line_dedup(rows))
    assert collections.Counter((r["doc_id"], r["text"]) for r in found.collect()) == {(1, twice): 2, (2, twice): 1, (3, thrice): 1, (None, ""): 1, (None, twice): 1}


def test_line_dedup_is_reversible(spark):
    docs = documents(spark)
    a, b, c = (docs.filter(F.col("doc_id") % 3 == k) for k in range(3))
    state = lambda ix: sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in ix.apply(a).collect())
    index = LineIndex(spark, spec=LineSpec(keys_per_shard=20, compact_after=3)).insert(a)
    before = state(index)
    index.insert(b).insert(c)
    full = {i: (t, d) for i, t, _, d in brute.line_dedup(pairs(spark))}
    assert all(full[i] == (t, d) for i, t, d in state(index))
    assert state(index.delete(b).delete(c)) == before
    hi, lo = split_keys(np.frombuffer(b"".join(bytes(r["key"]) for r in index.repeated().collect()), np.uint8).reshape(-1, 16))
    assert sum(int((CuckooFilter.loads(bytes(r["data"])).table != 0).sum()) for r in index.filters().collect()) == len(hi)


@settings(max_examples=25, deadline=None)
@given(st.sets(st.binary(min_size=16, max_size=16), min_size=1, max_size=300))
def test_cuckoo_filter(keys):
    hi, lo = split_keys(np.frombuffer(b"".join(sorted(keys)), np.uint8).reshape(-1, 16))
    held = CuckooFilter.build(hi, lo)
    assert held.contains(hi, lo).all()
    half = len(hi) // 2
    assert all(held.delete(int(a), int(b)) for a, b in zip(hi[:half], lo[:half], strict=True))
    assert CuckooFilter.loads(held.dumps()).contains(hi[half:], lo[half:]).all() and int((held.table != 0).sum()) == len(hi) - half


def test_full_cuckoo_filter_says_so():
    rnd = np.random.default_rng(1)
    hi, lo = rnd.integers(0, 1 << 63, 200).astype(np.uint64), rnd.integers(0, 1 << 63, 200).astype(np.uint64)
    small = CuckooFilter(np.zeros((8, 4), np.uint16))
    taken = [k for k in range(200) if small.insert(int(hi[k]), int(lo[k]))]
    assert 24 <= len(taken) <= 32 and small.contains(hi[taken], lo[taken]).all()


# 8 and 9. Tokens


@pytest.mark.parametrize(("name", "space"), [(WORD_BPE, "dropped"), (BYTE_BPE, "joined")])
def test_encoder_gives_the_librarys_ids(name, space):
    mine = Encoder(vocabulary_path(name), space, max_entries=50)
    rnd = random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u0301", "1", "'s", ".", "<|endoftext|>", "<|startoftext|>", "Σ", "日", "\r\n", "erth", "the.", "--", "\x85"]
    texts = [t or "" for t in odd_texts(7)] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    texts += ["x<|endoftext|>y", "<|endoftext|>", "a  <|startoftext|> b\n<|endoftext|><|endoftext|>  ", "<|ENDOFTEXT|> <|endoftext|", "the <|startoftext|>the"]
    plain = Tokenizer.from_file(vocabulary_path(name))
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)] == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, odd, empty, encoding):
    plain = Tokenizer.from_file(vocabulary_path(WORD_BPE))
    manifest = write_tokens(odd[0], spec=TokenStoreSpec(encoding=encoding, group_tokens=50, batch_docs=2))
    found = read_tokens(spark, manifest, digests=True).collect()
    ordered = sorted(odd[1], key=lambda r: (r[0] is not None, r[0] or 0, brute.spark_hash(r[1])))
    at, want = 0, []
    for i, t in ordered:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), brute.crc(ids), tuple(ids)))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in found), key=lambda x: x[1]) == want
    files = [r["path"].removeprefix("file://").removeprefix("file:") for r in manifest.collect()]
    stored = [pq.ParquetFile(f) for f in files]
    columns = [f.metadata.row_group(0).column(f.metadata.num_columns - 1) for f in stored]
    assert all(c.has_offset_index and ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY") in c.encodings for c in columns)
    assert max(f.num_row_groups for f in stored) > 1 and "ids" not in read_tokens(spark, manifest, with_ids=False).columns
    some = [3, 12, 12, 30, 999]
    picked = {(r["doc_id"], r["start"]) for r in read_tokens(spark, manifest, ids=some).collect()}
    assert picked == {(w[0], w[1]) for w in want if w[0] in some}
    ranged = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in read_tokens(spark, manifest, with_ids=False, digests=True, low=10, high=20).collect()}
    assert ranged == {(w[0], w[1], w[3]) for w in want if w[0] is not None and 10 <= w[0] <= 20}
    assert read_tokens(spark, manifest, ids=[]).count() == 0
    assert read_tokens(spark, write_tokens(empty)).count() == 0
    assert read_tokens(spark, write_tokens(odd[0].select("doc_id", "text"))).count() == len(odd[1])


def test_other_row_groups_are_not_read(spark, odd):
    """Files whose other row groups are damaged still give the selected documents."""
    manifest = write_tokens(odd[0].filter("doc_id is not null"), spec=TokenStoreSpec(group_tokens=20, batch_docs=1, partitions=1))
    path = manifest.first()["path"].removeprefix("file://").removeprefix("file:")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_row_groups > 10
    target, damaged = meta.row_group(5), bytearray(pathlib.Path(path).read_bytes())
    for k in range(meta.num_row_groups):
        if k != 5:
            for c in range(meta.num_columns):
                column = meta.row_group(k).column(c)
                at = column.dictionary_page_offset or column.data_page_offset
                damaged[at : at + column.total_compressed_size] = bytes(column.total_compressed_size)
    pathlib.Path(path).write_bytes(damaged)
    (pathlib.Path(path).parent / f".{pathlib.Path(path).name}.crc").unlink(missing_ok=True)
    wanted = target.column(0).statistics.min
    assert {r["doc_id"] for r in read_tokens(spark, manifest, ids=[wanted]).collect()} == {wanted}
    with pytest.raises(Exception):
        read_tokens(spark, manifest).count()


def check_packing(found, rows, capacity):
    plain = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    want = collections.Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (a, n) in enumerate(cuts(len(ids), capacity)):
            want[i, k, a, n, brute.crc(ids[a : a + n])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    ends = collections.defaultdict(int)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= capacity
    gaps, lengths = [], sorted((r["length"] for r in found), reverse=True)
    for n in lengths:  # serial best fit
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            gaps.append(capacity - n)
    assert len(ends) == len(gaps)


def test_packing(spark, odd, empty):
    for capacity in (64, 2048):
        found = pack_documents(odd[0], PackSpec(capacity=capacity)).collect()
        assert all(len(r["ids"]) == r["length"] and brute.crc(r["ids"]) == r["ids_crc32"] for r in found)
        check_packing(found, odd[1], capacity)
    check_packing(pack_documents(documents(spark), with_ids=False).collect(), pairs(spark), 2048)
    assert pack_documents(empty).count() == 0


def serial_best_fit(lengths, capacity):
    """Number of sequences of serial best-fit decreasing."""
    held = [0] * (capacity + 1)  # sequences by gap
    for n in sorted(lengths, reverse=True):
        gap = next((g for g in range(n, capacity + 1) if held[g]), None)
        if gap is not None:
            held[gap] -= 1
        held[(capacity if gap is None else gap) - n] += 1
    return sum(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.integers(1, 5))
def test_sweeps_match_as_one_stack(opens, parts):
    """Ranges swept apart, then met by ordinals, pair the same brackets as one stack."""
    stack, want, lone = [], {}, []
    for k, x in enumerate(opens):
        if x:
            stack.append(k)
        elif stack:
            want[k] = stack.pop()
        else:
            lone.append(k)
    got, left, closing, opening = {}, {}, {}, {}
    cut = [len(opens) * p // parts for p in range(parts + 1)]
    for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        first, second, alone, free = match_brackets(np.array(opens[a:b], bool))
        got |= {int(y) + a: int(x) + a for x, y in zip(first, second, strict=True)}
        closing[p], opening[p] = (alone + a).tolist(), (free + a).tolist()
        left[p] = (len(alone), len(free))
    rest = {}
    pairs, n_lone = meetings(left)
    for part, low, high, of, base in pairs:
        for k in range(low, high):
            if of is None:
                rest[base + k - low] = closing[part][k]
            else:
                got[closing[part][k]] = opening[of][base - (k - low)]
    assert got == want and [rest[k] for k in range(n_lone)] == lone


@pytest.mark.parametrize("kind", ["mixed", "short", "equal", "thirds"])
def test_rounds_pack_as_tightly_as_serial_best_fit(spark, kind):
    rnd = np.random.default_rng(4)
    lengths = {"mixed": np.minimum(2048, rnd.geometric(1 / 700, 3000)), "short": rnd.integers(1, 60, 3000), "equal": np.full(500, 700), "thirds": rnd.integers(600, 760, 1500)}[kind]
    pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "pid long, length long")
    found = place(pieces, PackSpec(ranges=5)).join(pieces, "pid").collect()
    ends = collections.defaultdict(int)
    for r in sorted(found, key=lambda r: (r["sequence"], r["offset"])):
        assert r["offset"] == ends[r["sequence"]]
        ends[r["sequence"]] += r["length"]
    assert len(found) == len(lengths) and max(ends.values()) <= 2048
    best = serial_best_fit(lengths.tolist(), 2048)
    assert best - 1 <= len(ends) <= best * 1.01 + 1


# 10. Decontamination


@pytest.mark.parametrize(("in_row", "common"), [(20_000, 64), (-1, 64), (20_000, 0), (-1, 1)])
def test_decontamination(spark, odd, empty, in_row, common):
    spec = WinnowSpec(in_row=in_row, common=common)
    items = [(1, "A common line that many documents share here and goes on for more than thirteen words"), (2, "the rain"), (3, None), (4, "..."), (5, "license Line x CC by"), (None, "Of"), (2, "the rain"), (6, "a a a a a a a a a a a a a a a a"), (7, " ".join("abcdefghijklmnop"))]
    texts = [(200, "x y " + " ".join("abcdefghijklmnop") + " z"), (201, " ".join("abcdefghijkl") + " q"), (202, "a " * 40), (203, "THE   rain"), (200, "x y " + " ".join("abcdefghijklmnop") + " z")]
    docs = odd[0].select("doc_id", "text", "words", "key").unionByName(spark.createDataFrame([(i, t, "w", "k") for i, t in texts], "doc_id long, text string, words string, key string"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    found = contamination(docs, bench, spec).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(map(str, r["items"]))), r["contaminated"]) for r in found)
    assert got == collections.Counter((i, n, h, tuple(m), c) for i, n, h, m, c in brute.contamination(odd[1] + texts, items))
    assert contamination(empty, bench, spec).count() == 0
    assert contamination(docs, bench.limit(0), spec).filter("contaminated or n_hit > 0").count() == 0


def test_decontamination_shuffled_benchmark(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(brute.contamination(pairs(spark), [(r["item_id"], r["text"]) for r in bench.collect()]))
    for spec in (WinnowSpec(), WinnowSpec(broadcast_rows=0), WinnowSpec(common=0)):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], sorted(map(str, r["items"])), r["contaminated"]) for r in contamination(documents(spark), bench, spec).collect())
        assert got == want


# The pipeline


def test_pipeline_against_brute_force(spark):
    rows = pairs(spark)
    kept = {r["doc_id"] for r in judge(documents(spark)).filter("kept").collect()}
    assert all(brute.rule_statistics(t)[-1] is False for i, t in rows if i in kept)
    rows = [(i, t) for i, t, _, _ in brute.line_dedup([(i, t) for i, t in rows if i in kept])]
    rows.sort()
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()  # tested by itself
    heads = collections.defaultdict(lambda: 1 << 60)
    for r in found:
        heads[r["root"]] = min(heads[r["root"]], r["doc_id"])
    rows = [r for r in rows if r[0] in heads.values()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, *_, c in brute.contamination(rows, items) if c}
    assert bad
    check_packing(corpus_pipeline.run(spark, SF).collect(), [r for r in rows if r[0] not in bad], 2048)


def test_stages_take_odd_rows(spark, odd):
    docs = odd[0].select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            assert stage(spark, frame, SF).columns == docs.columns
    assert corpus_pipeline.near_duplicate_stage(spark, docs, SF).count() == len({r["root"] for r in near_copies(docs).collect()})
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SF).count() == 0
