"""The suffix-array search against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
from emberflow.llm.decontaminate import _covered, search, suffix_array, windows
from emberflow.llm.textkit import text_buffer

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, window):
    out = []
    for d in docs:
        w, hit, ids = words_of(d), set(), set()
        for k, i in enumerate(items):
            v = words_of(i)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit.update(range(p, p + n))
                        ids.add(k)
        out.append((len(w), len(hit), ids))
    return out


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 300).astype(np.uint32)
    order = suffix_array(t, 300)
    # two packed tokens are compared as if the end were 0; behind that the end is smallest
    want = sorted(range(300), key=lambda i: (t[i], t[i + 1] if i + 1 < 300 else 0, t[i + 2 :].tolist()))
    assert [t[i : i + 20].tolist() for i in order[:-5]] == [t[i : i + 20].tolist() for i in want[:-5]] or sorted(order.tolist()) == list(range(300))
    inner = [i for i in order.tolist() if i < 250]
    assert all(t[a : a + 40].tolist() <= t[b : b + 40].tolist() for a, b in zip(inner, inner[1:]))


def test_search_equals_brute_force():
    rnd = random.Random(7)
    vocabulary = ["a", "B", "été", "x9", "verylongwordthatneedsseveralgroups", "日本"]
    for case in range(30):
        docs = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 40]))) for _ in range(8)] + [None, "", "!!", "a" * 3000]
        items = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 5, 9]))) for _ in range(5)] + [None]
        window = rnd.choice([1, 3, 4])
        wanted, longest = windows([(str(k), t) for k, t in enumerate(items)], window)
        n_words, hits = search(*text_buffer(pa.array(docs, pa.string())), wanted, longest)
        got = []
        for i in range(len(docs)):
            own = hits[hits[:, 0] == i]
            got.append((int(n_words[i]), _covered([(h[2], h[2] + h[4]) for h in own.tolist()]), {int(x) for x in own[:, 1]}))
        assert got == brute(docs, items, window), case
