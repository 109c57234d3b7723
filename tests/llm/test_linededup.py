"""Line dedup against a plain version, and its SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import oracle
import pytest
from llm_fixtures import sentence

from corpusq.llm import linededup, queries
from corpusq.plans.workspace import Workspace

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def plain(rows, min_docs=3, rounds=32):
    first = lambda d: (d is not None, d if d is not None else 0)
    lines = []
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            k = ["<*>" if re.search("[0-9]", x) else x for x in SPLIT.split(line) if x]
            if len(k) >= 5:
                lines.append((d, p, tuple(k)))
    groups, rest = defaultdict(set), sorted(lines, key=lambda r: (first(r[0]), r[1]))
    leaf = lambda k: (len(k), k[:4])
    for i in range(rounds + 1):
        crowd = Counter(leaf(k) for _, _, k in rest)
        crowded = {x for x, n in crowd.items() if n >= min_docs}
        if i == rounds:
            break
        template, left = {}, []
        for d, p, k in rest:
            t = template.setdefault(leaf(k), k) if leaf(k) in crowded else None
            if t is not None and (t == k or 2 * sum(x == y for x, y in zip(k[4:], t[4:])) >= len(k) - 4):
                groups["T", i, leaf(k)].add((d, p))
            else:
                left.append((d, p, k))
        rest = left
    places = Counter((leaf(k), i, k[i]) for _, _, k in rest if leaf(k) in crowded for i in range(4, len(k)))
    for d, p, k in rest:
        fixed = tuple((i, k[i]) for i in range(4, len(k)) if places[leaf(k), i, k[i]] >= min_docs)
        groups[("G", leaf(k), fixed) if leaf(k) in crowded and 2 * len(fixed) >= len(k) - 4 else ("M", k)].add((d, p))
    gone = set()
    for at in groups.values():
        if len({d for d, _ in at}) >= min_docs:
            gone |= at - {min(at, key=lambda x: (first(x[0]), x[1]))}
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(all_lines) if (d, p) not in gone]
        text = "\n".join(kept)
        out.append((d, len(all_lines), len(all_lines) - len(kept), len(text), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_equals_plain(spark, docs):
    rng = random.Random(2)
    boiler = ["Copyright %d by the %s company of all rights", "Posted on %d by %s in the daily news section", "click here to read more of this now", "a b c d %d %s z"]
    rows = []
    for i in range(150):
        lines = [sentence(rng, rng.randrange(0, 15)) for _ in range(rng.randrange(0, 5))]
        lines += [x % (rng.randrange(3000), rng.choice("xyz")) if "%" in x else x for x in rng.sample(boiler, rng.randrange(0, 4))]
        lines += rng.choices(["short line", "", "  ", "same same same same same same"], k=2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(None, "click here to read more of this now\nx"), (200, None), (201, ""), rows[3], (202, "click  here to read\tmore of this now\r"), (203, "w " * 100_000 + "\n" + "\n".join(["click here to read more of this now"] * 5000))]
    got = [tuple(r) for r in linededup.report(docs(rows, extra=True), Workspace(spark, "ld")).collect()]
    key = str
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert sum(r[2] for r in got) > 5000


def test_drop_lines(spark, docs):
    same = "one two three four five six"
    d = docs([(1, same + "\nown words"), (2, same), (3, same + "\nmore"), (4, None), (5, "")], extra=True)
    out = linededup.drop_lines(d, Workspace(spark, "ld"))
    assert out.columns == d.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (same + "\nown words", 37), 3: ("more", 4), 4: (None, 0), 5: ("", 0)}
    assert linededup.report(docs([]), Workspace(spark, "ld")).count() == 0


def test_no_python_in_plan(spark, docs):
    plan = linededup.report(docs(["a b c d e f"] * 4), Workspace(spark, "ld"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    assert oracle.compare(spark, d, queries.QUERIES["op1_line_dedup"], queries.ORACLE_SQL["op1_line_dedup"]) == 200


def test_lead_alone_is_no_likeness(spark, docs):
    tails = ["alpha beta gamma delta", "one two three four", "red green blue black", "north south east west"]
    unique = docs([f"it was the best {t}" for t in tails])
    assert [r.n_dropped for r in linededup.report(unique, Workspace(spark, "ld")).collect()] == [0] * 4
    half = docs([f"it was the best of times {t}" for t in ("alpha beta", "one two", "red green")])
    assert sum(r.n_dropped for r in linededup.report(half, Workspace(spark, "ld")).collect()) == 2


def test_short_lines(spark, docs):
    texts = [f"All rights reserved.\nPage {i} of\n{1900 + i}\n 7 \t8\n\nown{'abcd'[i]} words" for i in range(4)]
    out = linededup.drop_lines(docs(texts), Workspace(spark, "ld"), min_tokens=1)
    assert [r.text for r in out.orderBy("doc_id").collect()] == [texts[0], *[f"{1900 + i}\n\nown{'abcd'[i]} words" for i in (1, 2, 3)]]
    assert oracle.compare(spark, "/root/testdata/sf0.001", queries.QUERIES["op1_line_dedup_all"], queries.ORACLE_SQL["op1_line_dedup_all"]) == 200


def test_names_do_not_clash(spark, docs):
    same = "one two three four five six"
    names = ["_doc", "_kept", "_lines", "_drops", "drops", "drops_of", "kept_lines", "masked", "plain", "pos", "k1", "at", "all_lines"]
    d = docs([(1, same), (2, same + "\nmine"), (3, same), (None, None), (2, same)]).selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(names)])
    out = linededup.drop_lines(d, Workspace(spark, "ld"))
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) == [(1, same, 27), (2, "mine", 4), (None, None, 0)]
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert linededup.report(d, Workspace(spark, "ld")).count() == 5


def test_white_space_and_digits(spark, docs):
    lines = ["a  b\tc d\r", " a b c d ", "a b c 1x", "a b c \x0b d", "x" * 3000 + " y z w v", "é b c d 9", "\t\t", "a\x85b c d e f"]
    got = [tuple(r) for r in linededup.masked_lines(docs([(1, "\n".join(lines)), (2, None), (3, "\n\n a1 "), (4, "a b \n \n c\n")])).select("doc_id", "pos", "masked", "tokens").collect()]
    want = []
    for d, text in [(1, "\n".join(lines)), (2, ""), (3, "\n\n a1 "), (4, "a b \n \n c\n")]:
        for p, line in enumerate(text.split("\n")):
            k = ["<*>" if re.search("[0-9]", x) else x for x in SPLIT.split(line) if x]
            want.append((d, p, " ".join(k), len(k)))
    assert sorted(got) == sorted(want)


def test_a_leaf_has_several_templates(spark, docs):
    shared = "please read this first"
    families = [f"{shared} the {{}} will open at nine today", f"{shared} our {{}} is closed until further notice", f"{shared} some {{}} never come back again then"]
    words = ["shop", "library", "gate"]
    texts = ["\n".join(f.format(w) for f in families) + f"\n{shared} {own}" for w, own in zip(words, ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "north south east west up down left"))]
    got = {r.doc_id: r for r in linededup.report(docs(texts), Workspace(spark, "ld")).collect()}
    assert [got[i].n_dropped for i in range(3)] == [0, 3, 3]
    many = [f"{shared} {c * 3} {c * 4} {c * 5} {c * 6}" for c in "abcdefgh"]
    got = linededup.report(docs(["\n".join(many)] * 3), Workspace(spark, "ld")).collect()
    assert sorted(r.n_dropped for r in got) == [0, 8, 8]


def test_many_families_in_a_leaf(spark, docs):
    """Eight families of five lines with one lead: each loses all lines but its first, whatever its turn."""
    words = "amber birch cedar dune ember fjord grove heath".split()
    rows = [(10 * f + i, f"all lines start alike {w} {w}s {w}ly {w}ness {'abcde'[i]}x") for f, w in enumerate(words) for i in range(5)]
    rows.append(rows[-1])  # a repeated row changes nothing
    got = {d: n for d, _, n, *_ in (tuple(r) for r in linededup.report(docs(rows), Workspace(spark, "ld")).collect())}
    assert got == {d: int(d % 10 > 0) for d, _ in rows}


@pytest.mark.parametrize("rounds", [0, 1, 32])
def test_random_leaves_equal_plain(spark, docs, monkeypatch, rounds):
    monkeypatch.setattr(linededup, "ROUNDS", rounds)
    rng = random.Random(8)
    rows = [(i, "\n".join("one lead for all " + " ".join(rng.choice("abcd" if rng.random() < 0.7 else "efghijklmnopqrst") for _ in range(rng.choice([3, 4, 6]))) for _ in range(6))) for i in range(60)]
    rows += [rows[5], (None, rows[9][1]), (None, rows[9][1])]
    got = sorted((tuple(r) for r in linededup.report(docs(rows), Workspace(spark, "ld")).collect()), key=str)
    assert got == sorted(plain(rows, rounds=rounds), key=str) and (sum(r[2] for r in got) > 5 or not rounds)
