"""Spelling variants against a plain version."""

import random
import re
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import spelling
from corpusq.plans.workspace import Workspace

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, damage=199):
    count = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(SMALL)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    rows = {}
    for w, k in n.items():
        others = sorted((-n[x], x) for x in n if x != w and near(w, x))
        form = others[0][1] if others and -others[0][0] >= 5 * k else None
        rows[w] = (form, k, len(others), n[form] if form else None)
    out = {}
    for w, (form, *rest) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (form, root, *rest)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_equal_to_plain(docs, spark):
    rng = random.Random(5)
    stems = ["planet", "plannet", "planets", "été-là", "straßen", "ÀÉÎÕÜß", "aaaaaa", "aaaaaaa", "aaaaab", "ababab", "bababa", "possible", "Possibel"]
    words = [s[:i] + rng.choice("abé") + s[i + rng.randrange(2) :] for s in stems for i in range(len(s)) for _ in range(2)] + stems * 4
    rows = [(i, " ".join(rng.choices(words, [1 + 40 * (k % 9 == 0) for k in range(len(words))], k=60))) for i in range(150)]
    rows += [(150, None), (151, ""), (None, "planet " * 400), (7, rows[7][1]), (152, "planet," * 3000)]
    for damage in (199, 3):
        got = rows_of(spelling.group_variants(docs(rows, extra=True), Workspace(spark, "t"), damage=damage))
        assert got == plain(rows, damage) and any(v[0] for v in got.values())


def test_chains_lead_to_their_last(docs, spark):
    chain = ["abcdefgh", "abcdefg", "abcdef", "xabcdef", "xabcdefy"]
    d = docs([" ".join(f"{w} " * 5 ** (k + 1) for k, w in enumerate(chain))])
    got = rows_of(spelling.group_variants(d, Workspace(spark, "t")))
    assert {w: v[1] for w, v in got.items()} == dict.fromkeys(chain, "xabcdefy") and got["abcdefgh"][0] == "abcdefg"
    family = spelling.families(spelling.group_variants(d, Workspace(spark, "t"))).collect()
    assert [tuple(r) for r in family] == [("xabcdefy", 5, sum(5 ** (k + 1) for k in range(5)))]


def test_ties_go_by_code_points(docs, spark):
    d = docs(["planeta " * 5 + "planetz " * 30 + "planeté " * 30 + "planetb " * 30])
    assert rows_of(spelling.group_variants(d, Workspace(spark, "t")))["planeta"] == ("planetb", "planetb", 5, 3, 30)


def test_empty_and_long_words(docs, spark):
    assert rows_of(spelling.group_variants(docs([]), Workspace(spark, "t"))) == {}
    assert rows_of(spelling.group_variants(docs([None, "", "short words are not taken"]), Workspace(spark, "t"))) == {}
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    d = docs([f"{long} " * 5 + f"{long[:9000]}{long[9001:]} " * 25, "a" * 50_000, ("b" * 20_000 + " ") * 6])
    got = rows_of(spelling.group_variants(d, Workspace(spark, "t")))
    assert len(got) == 3 and got[long] == (long[:9000] + long[9001:],) * 2 + (5, 1, 25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aabcé", min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
def test_shared_names_are_near_pairs_and_only_once(words):
    by = {}
    for of, k1, k2, size, low, high in zip(*(x.tolist() for x in spelling.names(words))):
        by.setdefault((k1, k2, size), []).append((of, low, high))
    found = Counter()
    for sent in by.values():
        for a, la, ha in sent:
            for b, lb, hb in sent:
                if a < b and (la < 0 or lb < 0 or (la <= hb and lb <= ha)):
                    found[a, b] += 1
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}
    assert set(found) == want and set(found.values()) <= {1}


def test_nothing_that_grows_with_the_words_is_broadcast(docs, spark):
    ws = Workspace(spark, "t")
    words = ws.save("words", spark.createDataFrame([(i, 5, f"abcdef{i}") for i in range(50)], "id long, n long, word string"))
    links = ws.save("links", spark.createDataFrame([(1, 0)], "id long, form long"))
    found = spelling.group_variants(docs(["kernel " * 30 + "kernal " * 5]), ws)
    for df in (spelling.near_words(words), found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in spelling.roots(links, ws).collect()] == [(1, 0)]
