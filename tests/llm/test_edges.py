"""Every operator on odd rows: nulls, empty, blank and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabaudit.llm import audio, katz, lines, merkle, near_dedup, packing, pieces, pii, quality, token_files
from tabaudit.llm.queries import vocabulary_path
from tabaudit.llm.store import work_dir

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon over the hill", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "   \n\t ", "en", "a", 5),
    (5, LONG, "en", "b", 9),
    (6, "one", "fr", "a", 3),
    (7, "the cat sat on the mat and looked at the moon over the hill", "en", "a", 1),
    (7, "the cat sat on the mat and looked at the moon over the hill", "en", "a", 1),
    (None, "no id here, mail a.b1@example.org", "en", "a", 2),
    (9, "line one is here\nline one is here\n!!!\nLine, one is HERE", "en", "a", 7),
    (10, "call +1 (489) 555-0950 or 4111 1111 1111 1111\nthe end", "en", "a", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns with the names that operators add.
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit(1).alias(c) for c in ("n_lines", "n_card", "n_tokens", "start", "task", "component", "bucket", "shard")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return {d: t or "" for d, t, *_ in ROWS}


def test_lines(docs, none):
    got = {(r["doc_id"]): r for r in lines.dedup_lines(docs).collect()}
    assert len(lines.dedup_lines(docs).collect()) == len(ROWS) and lines.dedup_lines(none).count() == 0
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "   \n\t " and got[None]["text"] == ROWS[8][1]
    assert got[1]["text"] == ROWS[0][1] and got[7]["text"] == ""
    assert got[9]["text"] == "line one is here\n!!!" and (got[9]["dedup_n_lines"], got[9]["n_removed"], got[9]["n_lines"]) == (4, 2, 1)


def test_merkle(docs, none):
    rows = merkle.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS) and merkle.edited_fingerprints(none).count() == 0
    order = sorted((r for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, r in enumerate(order):
        t, nxt = r[1] or "", (order[(i + 1) % len(order)][1] or "")
        k = len(t) // 3
        want = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert any(x["doc_id"] == r[0] and x["edited_sha256"] == want and x["n_chars"] == len(t) for x in rows), r[0]
    same = {x["fingerprint"] for x in rows if x["doc_id"] in (1, 7)}
    assert len(same) == 1 and all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in rows)
    long = next(x for x in rows if x["doc_id"] == 5)
    assert long["near_edited"] > long["near_next"]


def test_merkle_tree_locates_edits(spark):
    a = "one two\nthree four\n\nfive six\n# head\nseven"
    df = spark.createDataFrame([(a, a.replace("five", "5"), a)], "a string, b string, c string")
    t = df.select(*(merkle.sections(F.col(c)).alias(c) for c in "abc"))
    r = t.select(F.size("a").alias("n"), (merkle.root(F.col("a")) == merkle.root(F.col("c"))).alias("same"), (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("other"), F.size(merkle.differing_paragraphs(F.col("a"), F.col("b"))).alias("d")).first()
    assert tuple(r) == (3, True, False, 1)


def test_packing(docs, none, spark):
    path = vocabulary_path("word_bpe_49k.json")
    rows = packing.pack(packing.pieces(docs, path, capacity=64), work_dir(spark, "t"), capacity=64).collect()
    assert packing.pack(packing.pieces(none, path), work_dir(spark, "t")).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert {r["doc_id"] for r in rows} == {d for d, *_ in ROWS} and all(r["length"] == 64 or r["length"] <= 64 for r in rows)
    assert sum(r["doc_id"] == 7 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]


def test_pieces(docs, none):
    path = vocabulary_path("piece_bpe_32k.model")
    rows = pieces.round_trip(docs, path).collect()
    assert len(rows) == len(ROWS) and all(r["lossless"] for r in rows) and pieces.round_trip(none, path).count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(pieces.sample_encode(docs, path), path).collect()}
    assert back == texts()


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (7, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and {"quality_n_tokens", "perplexity", "threshold", "accepted"} <= set(rows[0].asDict())
    assert all(r["accepted"] for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(none, labels).count() == 0


def test_audio(docs, none):
    rows = audio.audio_features(docs).collect()
    assert len(rows) == len(ROWS) and audio.audio_features(none).count() == 0
    for r in rows:
        p = audio.payload(texts()[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:]) and bytes(r["media"])[44 : 44 + len(p)] == p
        assert len(r["mel"]) == r["n_frames"] * audio.MELS
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 7)}) == 1


def test_near_dedup(docs, none):
    rows = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == len(ROWS) and near_dedup.near_duplicates(none).count() == 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (12, 1, True) and got[7] == (12, 1, False) and got[2] == (0, 2, True) and got[4] == (0, 4, True) and got[6] == (1, 6, True)
    assert got[None][1:] == (None, True)


def test_token_files(docs, none, spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    folder = work_dir(spark, "t")
    index = token_files.write_token_files(docs, path, folder, length=32)
    rows = sorted(token_files.read_token_digests(index, folder).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(path)
    start = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, row in zip(rows, order, strict=True):
        ids = [*t.encode(row[1] or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], start, len(ids), crc)
        start += len(ids)
    shard = index.agg(F.max("shard")).first()[0]
    ids, mask = token_files.ShardReader(folder, shard).sequence(0)
    assert len(ids) == len(mask) == 32
    empty = work_dir(spark, "t")
    assert token_files.read_token_digests(token_files.write_token_files(none, path, empty), empty).count() == 0


def test_katz(docs, none):
    rows = katz.katz_scores(docs).collect()
    assert len(rows) == len(ROWS) and katz.katz_scores(none).count() == 0
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1 and got[5]["n_tokens"] == 30_001
    assert all(r["score"] <= 0 and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    nothing = katz.katz_scores(docs.where("doc_id is null").withColumn("doc_id", F.lit(2).cast("long")))
    assert nothing.count() == 1


def test_pseudonyms(docs, none):
    rows = pii.pseudonymise(docs, b"k").collect()
    assert len(rows) == len(ROWS) and pii.pseudonymise(none, b"k").count() == 0
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[1]["text"] == ROWS[0][1]
    assert got[10]["n_found"] == 2 and "555-0950" not in got[10]["text"] and got[10]["text"].endswith("\nthe end") and got[10]["n_card"] == 1 and got[10]["pii_n_card"] == 1
    assert got[None]["n_found"] == 1
