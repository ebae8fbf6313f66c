"""The whole result of op3 against plain Python, hash by hash."""

import hashlib
import random

import brute
from pyspark.sql import functions as F

from cairngraph.llm import fingerprint, textbatch

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


TABLE = [mixed((b + 1) * 0x9E3779B97F4A7C15 & MASK) for b in range(256)]


def polynomial(values, base):
    return sum(v * pow(base, i, 1 << 64) for i, v in enumerate(values)) & MASK


def sketch(text, k=5):
    words = [mixed(polynomial([TABLE[b] for b in w.encode()], textbatch._BASE)) for w in brute.WORDS.findall(text)]
    if not words:
        return []
    size = min(k, len(words))
    hashes = [mixed((polynomial(words[i : i + size], textbatch._WORD_BASE) + size) & MASK) for i in range(len(words) - size + 1)]
    kept = [h for h in hashes if h < (1 << 61)] or [min(hashes)]
    return sorted({h >> 24 for h in kept})


def alike(a, b):
    if a == b:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def test_whole_result_equals_plain_python(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("na", "te", "ro", "é", "日") for b in ("", "n", "s", "t")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", " \t\n", "word", "two words", make(6000), None, make(3)]
    rows = [(7 * i - 100, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "range", "ahead", "fingerprint", "place")}).repartition(3)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        own, changed, following = sketch(t), sketch(edited), sketch(n)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h:010x}" for h in own) and r.edited_fingerprint == "".join(f"{h:010x}" for h in changed)
        assert r.near_edited == alike(own, changed) and r.near_next == alike(own, following)


def test_merge_is_the_sketch_of_both():
    for a, b in (("one two three four five six seven", "x"), ("x", "y"), (" ".join(map(str, range(300))), "x"), ("", "x"), ("", "")):
        enc = lambda hashes: "".join(f"{h:010x}" for h in hashes)
        both = sorted(set(sketch(a)) | set(sketch(b)))
        want = [h for h in both if h < 1 << 37] or both[:1]
        assert fingerprint.merge(enc(sketch(a)), enc(sketch(b))) == enc(want)
