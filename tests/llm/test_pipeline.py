"""Each stage of the pipeline against a plain version of what it is for."""

import random
import re

import numpy as np
import pytest

from tabaudit.llm import katz, lines, near_dedup, pii
from tabaudit.llm.groups import Union, blocks, connected_components
from tabaudit.llm.store import save, work_dir

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def words(r, n):
    return [("".join(r.choice("aeiourstln") for _ in range(r.randint(3, 9)))) for _ in range(n)]


def test_quality_keeps_what_reads_like_trusted_text(spark, sf_dir):
    r = random.Random(1)
    known = words(r, 60)
    texts = [" ".join(r.choice(known) for _ in range(60)) if i % 2 == 0 else " ".join(words(r, 60)) for i in range(60)]
    kept = corpus_pipeline.quality(spark, frame(spark, [*texts, None, ""]), sf_dir)
    ids = {x["doc_id"] for x in kept.collect()}
    assert kept.columns == COLUMNS and len(ids & set(range(0, 60, 2))) >= 28 and len([i for i in ids if i < 60 and i % 2]) <= 3


def test_lines_leave_no_similar_pair(spark, sf_dir):
    r = random.Random(2)
    base = [" ".join(words(r, 24)) for _ in range(12)]
    near = [re.sub(r"^\S+", "changed", b) for b in base]
    texts = ["\n".join(base[i : i + 4]) for i in range(0, 12, 4)] + ["\n".join(near[i : i + 4] + [" ".join(words(r, 20))]) for i in range(0, 12, 4)] + [None, "", "--\n--"]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, frame(spark, texts), sf_dir).collect()}
    left = [lines.normalised(x) for t in got.values() if t for x in t.split("\n") if lines.normalised(x)]
    assert len(left) == 15 and not any(lines.within(a, b) for i, a in enumerate(left) for b in left[:i])
    assert got[0] == texts[0] and got[6] is None and got[7] == "" and got[8] == "--\n--"


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(texts, width, percent):
    sets, u = [shingles(t, width) for t in texts], Union(len(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u.join(i, j)
    return [u.find(i) for i in range(len(texts))]


def near_texts():
    r = random.Random(3)
    out = []
    for n in (3, 8, 30, 60, 200):
        base = words(r, n)
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join("x" if r.random() < share else w for w in base))
    return [*out, None, "", "one", "One", "two words", "two  words", " ".join(words(r, 50))]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, width, percent):
    texts = near_texts()
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(frame(spark, texts), width=width, percent=percent).collect()}
    want = plain_components(texts, width, percent)
    assert got == {i: (len(shingles(t, width)), c, c == i) for i, (t, c) in enumerate(zip(texts, want, strict=True))}


def test_near_dedup_keeps_the_least_of_each_group(spark, sf_dir):
    texts = near_texts()
    kept = sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame(spark, texts), sf_dir).collect())
    assert kept == sorted(set(plain_components(texts, 5, 80)))


def test_pii_leaves_no_valid_number(spark, sf_dir):
    texts = ["card 4111 1111 1111 1111 here", "order 12 4111111111111111", "ref 7 4111 1111 1111 1111", "mail bob@example.org now", "born 1990-05-17", None, "", "nothing 5", "at 010.001.001.001 and 10.1.1.1, not 010.001.1.1"]
    got = corpus_pipeline.pii(spark, frame(spark, texts), sf_dir)
    by = {x["doc_id"]: x["text"] for x in got.collect()}
    assert got.columns == COLUMNS and not any(v in (t or "") for t in by.values() for v in ("4111 1111 1111 1111", "4111111111111111", "bob@", "1990-05-17"))
    assert by[5] is None and by[6] == "" and by[7] == "nothing 5"
    cipher = pii.Cipher(corpus_pipeline.PII_KEY)
    assert [pii.pseudonymise_text(by[i], cipher, {}, back=True) for i in (0, 1, 2, 3, 4, 8)] == [texts[i] for i in (0, 1, 2, 3, 4, 8)]
    assert re.fullmatch(r"at (\d{3}\.){3}\d{3} and [\d.]+, not 010\.001\.1\.1", by[8]) and "010.001.001.001" not in by[8]


def test_packing_has_every_piece_once(spark, sf_dir):
    r = random.Random(4)
    texts = [" ".join(words(r, n)) for n in (1, 5, 50, 900, 4000)] + [None, ""]
    rows = corpus_pipeline.packing(spark, frame(spark, texts), sf_dir).collect()
    by: dict[int, list] = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert {x["doc_id"] for x in rows} == set(range(7)) and all(x["start"] == 4096 * x["piece"] for x in rows)


def test_components_and_blocks(spark):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    u = Union(1100)
    for a, b in pairs:
        u.join(a, b)
    edges = save(spark.createDataFrame(pairs, "a long, b long"), work_dir(spark, "edges"), "edges")
    got = {x["node"]: x["component"] for x in connected_components(edges, work_dir(spark, "components"), "c").collect()}
    assert got == {v: u.find(v) for p in pairs if p[0] != p[1] for v in p}
    members = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1), ("h", 2), ("i", 3)], "grp string, node long")
    tasks: dict[int, set] = {}
    for x in blocks(members, "grp", "node", 8).collect():
        tasks.setdefault((x["grp"], x["task"]), set()).add(x["node"])
    assert all(any({a, b} <= t for (g, _), t in tasks.items() if g == "g") for a in range(50) for b in range(a))
    assert max(map(len, tasks.values())) < 40 and not any(g == "i" for g, _ in tasks)


def test_katz_scores_against_a_plain_scorer(spark):
    """The held-out mean beats the base, and probabilities of all continuations of a context sum to one."""
    r = random.Random(6)
    vocabulary = words(r, 30)
    texts = [" ".join(vocabulary[(i + 3 * k + r.randint(0, 2)) % 30] for k in range(40)) for i in range(120)]
    rows = katz.katz_scores(frame(spark, texts)).collect()
    held = [x for x in rows if x["held_out"]]
    assert held and sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert all(x["n_tokens"] == 41 for x in rows) and len({x["train_tokens"] for x in rows}) == 1
