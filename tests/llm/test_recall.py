"""Line dedup against brute force over all pairs."""

import random

from tabaudit.llm import lines
from tabaudit.llm.groups import Union


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(r, words, share):
    """A copy with whole words replaced, dropped or added, or with letters changed, up to a share of its length."""
    left, out = int(share * len(" ".join(words))), list(words)
    while left > 0:
        k = r.randrange(len(out))
        kind = r.choice(("replace", "drop", "add", "letter"))
        cost = {"replace": len(out[k]), "drop": len(out[k]) + 1, "add": 6, "letter": 1}[kind]
        left -= cost
        if left < 0:
            break
        if kind == "drop" and len(out) > 2:
            del out[k]
        elif kind == "add":
            out.insert(k, "".join(r.choice("bcdfgh") for _ in range(5)))
        elif kind == "replace":
            out[k] = "".join(r.choice("bcdfgh") for _ in out[k])
        else:
            i = r.randrange(len(out[k]))
            out[k] = out[k][:i] + "z" + out[k][i + 1 :]
    return " ".join(out)


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 11))) for _ in range(400)]
    rows = []
    for n in [4, 6, 9, 12, 20, 30] * 8:
        base = [r.choice(vocabulary) for _ in range(n)]
        rows += [" ".join(base), *(edited(r, base, share) for share in (0.05, 0.1, 0.15, 0.2))]
    text = list(dict.fromkeys(rows))
    r.shuffle(text)
    want, got = Union(len(text)), Union(len(text))
    pairs = [(i, j) for j, b in enumerate(text) for i, a in enumerate(text[:j]) if abs(len(a) - len(b)) <= 0.25 * len(a) and lines._unmatched(a, b) <= 0.2 * max(len(a), len(b))]
    pairs = [(i, j) for i, j in pairs if plain_distance(text[i], text[j]) <= int(0.2 * max(len(text[i]), len(text[j])) + 1e-9)]
    for i, j in pairs:
        want.join(i, j)
    stays = {i for i in range(len(text)) if want.find(i) == i}
    assert len(pairs) > 200 and len(stays) < 0.4 * len(text)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    kept = {row["doc_id"] for row in lines.dedup_lines(df).collect() if row["text"]}
    # Nothing goes that brute force keeps; the sketches may lose a pair that letters changed all over.
    assert kept >= stays
    assert len(kept - stays) <= 0.03 * (len(text) - len(stays))


def test_words_dropped_and_added_are_decided_without_distances(monkeypatch):
    r = random.Random(8)
    pairs = []
    for n in [6, 10, 25] * 20:
        a = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = [r.choice(("x", "yz yz", "long"))] * r.randint(0, 2)
            b = b or ["x"]
        pairs.append((a, b))
    assert all(lines.aligned(a, b, 10**6) >= plain_distance(" ".join(a), " ".join(b)) for a, b in pairs)
    assert [lines.within(" ".join(a), " ".join(b)) for a, b in pairs] == [plain_distance(" ".join(a), " ".join(b)) <= int(0.2 * max(len(" ".join(a)), len(" ".join(b))) + 1e-9) for a, b in pairs]
    monkeypatch.setattr(lines, "levenshtein", None)  # is not called
    text = " ".join(f"word{i}" for i in range(40))
    assert lines.within(text, text.replace("word7 ", "").replace("word20", "word20 more"))
