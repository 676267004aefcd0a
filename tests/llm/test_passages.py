import random

import numpy as np

from paperlake.llm import passages as P


def cartesian(v, least):
    """All (centre, left, right) of span at least ``least``, by recursion, clipped."""
    out, todo = [], [(0, len(v) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 < least:
            continue
        c = min(range(a, b + 1), key=lambda i: (v[i], i))
        out.append((c, max(a, c - least + 1), min(b, c + least - 1)))
        todo += [(a, c - 1), (c + 1, b)]
    return sorted(out)


def test_windows_are_nodes_of_the_cartesian_tree():
    rng = random.Random(1)
    for n in (0, 5, 8, 9, 60, 300):
        for values in (3, 10**6):
            v = np.array([rng.randint(1, values) << 24 for _ in range(n)], np.uint64)
            assert sorted(zip(*(x.tolist() for x in P.compact_windows(v, 8)))) == cartesian(v.tolist(), 8)


def test_windows_of_several_sequences_at_once():
    rng = random.Random(2)
    parts = [np.array([rng.randint(1, 50) << 24 for _ in range(n)], np.uint64) for n in (3, 40, 0, 8, 7, 90)]
    got = sorted(zip(*(x.tolist() for x in P.compact_windows(np.concatenate(parts), 8, np.array([len(x) for x in parts])))))
    want, at = [], 0
    for x in parts:
        want += [tuple(at + y for y in w) for w in cartesian(x.tolist(), 8)]
        at += len(x)
    assert got == sorted(want)


def test_contexts_are_equal_only_with_equal_shingles_and_place():
    rng = random.Random(5)
    s = np.array([rng.randrange(1 << 64) for _ in range(30)] * 3, np.uint64)
    lo, hi, c = (np.array(x) for x in ([0, 30, 60, 0, 0, 1], [20, 50, 80, 20, 21, 21], [4, 34, 64, 5, 4, 5]))
    h = P.contexts_of(s, lo, hi, c).tolist()
    assert h[0] == h[1] == h[2] and len(set(h)) == 4


def test_pieces_of_a_very_long_text(spark):
    """A text of more shingles than are looked at together has the windows of the whole."""
    rng = random.Random(8)
    n = P._SHINGLES + 30_000
    text = " ".join(str(rng.randrange(1 << 20)) for _ in range(n))
    s = P.shingle_hashes(text.encode(), P._Words())
    want = sorted(zip(*(x.tolist() for x in P.compact_windows(P._mix(s ^ P._SEEDS[0]), P.LEAST))))
    rows = P.window_table(spark.createDataFrame([(1, text)], "uid long, text string"), functions=1).collect()
    v = P._mix(s ^ P._SEEDS[0]).view(np.int64)
    assert sorted((r["left"], r["right"], r["low"]) for r in rows) == sorted((a, b, int(v[c])) for c, a, b in want)


def words(rng, n, vocab="abcdefghij"):
    return ["".join(rng.choice(vocab) for _ in range(rng.randint(3, 8))) for _ in range(n)]


def corpus():
    rng = random.Random(9)
    docs, want = {}, {}
    for i in range(40):
        docs[i], want[i] = words(rng, rng.randint(5, 260)), i
    passage, near = words(rng, 56), words(rng, 90)
    for i in (50, 51, 52):  # an exact passage of over fifty words in other surroundings
        docs[i], want[i] = words(rng, rng.randint(0, 90)) + passage + words(rng, rng.randint(0, 90)), 50
    edited = list(near)
    edited[45] = "CHANGED"
    docs[60], docs[61] = words(rng, 60) + near, edited + words(rng, 30)
    want[60] = want[61] = 60
    for i in range(70, 110):  # copies and near copies
        w = list(docs[20] if len(docs[20]) > 200 else docs.setdefault(200, words(rng, 240)))
        if i % 2:
            w[rng.randrange(len(w))] = f"edit{i}"
        docs[i] = w
    base = 20 if len(docs[20]) > 200 else 200
    for i in range(70, 110):
        want[i] = min(base, 70)
    want[base] = min(base, 70)
    short = words(rng, 30)
    docs[120], docs[121] = words(rng, 40) + short, short + words(rng, 40)
    want[120], want[121] = 120, 121
    return {i: " ".join(w) for i, w in docs.items()}, want


def test_classes(spark):
    docs, want = corpus()
    rows = [*docs.items(), (300, None), (301, ""), (302, "one"), (302, "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, passages string")
    got = P.passages_query(df).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    for i, c in {**want, 300: 300, 301: 301, 302: 302}.items():
        assert found[i]["class_id"] == c, (i, found[i])
    assert found[50]["n_words"] >= 50 and found[120]["n_passages"] == 0 and found[0]["passages"] == ""


def test_groups_lose_no_link():
    rng = random.Random(3)
    for _ in range(40):
        base, line = [rng.randrange(1 << 30) for _ in range(30)], [rng.randrange(1 << 30) for _ in range(6)]
        members = []
        for u in range(16):
            x = list(base) if u % 2 else [rng.randrange(1 << 30) for _ in range(30)]
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(30)] = rng.randrange(1 << 30)
            x[12:18] = line
            members.append((u, rng.choice([u, u // 4]) + 100, 0, np.array(x, np.uint32).tobytes()))
        rows = [np.frombuffer(m[3], np.uint32).tolist() for m in members]
        need = P._needed(20, 0.8)

        def joined(links):
            root = {m[1]: m[1] for m in members}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                root[find(members[a][1])] = find(members[b][1])
            return [[find(members[a][1]) == find(members[b][1]) for a in range(16)] for b in range(16)]

        similar = [(a, b) for a in range(16) for b in range(a) if min(P.best_stretch(rows[a], set(rows[b]), 20)[0], P.best_stretch(rows[b], set(rows[a]), 20)[0]) >= need]
        assert joined([(a, b) for a, b, *_ in P.group_links(members, 20, 0.8)]) == joined(similar)


def test_groups_lose_no_link_of_repeated_lines():
    rng = random.Random(4)
    for case in range(60):
        line = [rng.randrange(1 << 30) for _ in range(rng.randint(3, 12))]
        base = (line * 20)[:30] if case % 2 else line + [rng.randrange(1 << 30) for _ in range(30 - 2 * len(line))] + line
        rows = []
        for u in range(8):
            x = list(base) if u % 2 else [rng.choice(line) if rng.random() < 0.5 else rng.randrange(1 << 30) for _ in range(30)]
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(30)] = rng.randrange(1 << 30)
            rows.append([rng.randrange(1 << 30) for _ in range(rng.randint(0, 8))] + x + [rng.randrange(1 << 30) for _ in range(rng.randint(0, 8))])
        members = [(u, 100 + u, 0, np.array(x, np.uint32).tobytes()) for u, x in enumerate(rows)]
        need = P._needed(20, 0.8)
        root = {u: u for u in range(8)}
        for a in range(8):
            for b in range(a):
                if min(P.best_stretch(rows[a], set(rows[b]), 20)[0], P.best_stretch(rows[b], set(rows[a]), 20)[0]) >= need:
                    root = {u: root[b] if r == root[a] else r for u, r in root.items()}
        got = {u: u for u in range(8)}
        for a, b, *_ in P.group_links(members, 20, 0.8):
            got = {u: got[b] if r == got[a] else r for u, r in got.items()}
        assert all((root[a] == root[b]) == (got[a] == got[b]) for a in range(8) for b in range(a)), case


def test_passages_with_lines_twice_or_more(spark):
    rng = random.Random(6)
    docs, want = {}, {}
    for k, size in enumerate((8, 9, 10, 11, 12)):
        line = words(rng, size)
        for m, passage in enumerate((line + words(rng, 50 - 2 * size) + line, (line * 9)[: 50 + 8 * k])):
            for side in (0, 1):
                docs[100 * k + 10 * m + side] = words(rng, 70) + passage + words(rng, 70)
                want[100 * k + 10 * m + side] = 100 * k + 10 * m
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in P.passages_query(df).collect()} == want


def test_recall_at_the_threshold(spark):
    """Passages of one stretch, one word changed in the middle (similarity 41/51), against all pairs."""
    rng = random.Random(12)
    docs = []
    for _ in range(300):
        passage = words(rng, 50)
        edited = [*passage[:25], "CHANGED", *passage[26:]]
        docs += [words(rng, rng.randint(0, 40)) + w + words(rng, rng.randint(0, 40)) for w in (passage, edited)]
    rows = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in docs]
    where, need = {}, P._needed(P.LEAST, P.SIMILARITY)
    for i, x in enumerate(rows):
        for s in x:
            where.setdefault(s, set()).add(i)
    near = {(a, b) for at in where.values() for a in at for b in at if a < b}
    similar = {(a, b) for a, b in near if min(P.best_stretch(rows[a], set(rows[b]), P.LEAST)[0], P.best_stretch(rows[b], set(rows[a]), P.LEAST)[0]) >= need}
    assert len(similar) == 300
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in P.passages_query(df).collect()}
    found = sum(got[a] == got[b] for a, b in similar)
    assert found >= 0.99 * len(similar)


def test_near_passages_of_documents_tied_already(spark):
    """An exact passage ties two documents; a near one elsewhere in them has its spans too."""
    rng = random.Random(15)
    docs, where = [], []
    for _ in range(40):
        exact, near = words(rng, 60), words(rng, 90)
        edited = [*near[:45], "CHANGED", *near[46:]]
        docs += [exact + words(rng, 60) + near + words(rng, 20), words(rng, 30) + edited + words(rng, 70) + exact]
        where += [((0, 60), (120, 210)), ((30, 120), (190, 250))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.passages_query(df).collect()}
    assert all(got[i]["class_id"] == i - i % 2 for i in got)
    spans = {i: [tuple(map(int, s.split(":"))) for s in r["passages"].split(",")] for i, r in got.items()}
    lost = [i for i in spans for a, b in where[i] if not any(x <= a and b <= y for x, y in spans[i])]
    assert len(lost) <= 2, lost


def test_every_similar_context_has_its_span(spark, monkeypatch):
    """Small and large groups, also of one class, repeats and contexts of one document."""
    rng = random.Random(16)
    for case in range(60):
        base = [rng.randrange(1 << 30) for _ in range(39)]
        rows = []
        for u in range(40):
            x = list(base) if rng.random() < 0.7 else [rng.randrange(1 << 30) for _ in range(39)]
            for _ in range(rng.randint(0, 7)):
                x[rng.randrange(39)] = rng.choice([rng.randrange(1 << 30), base[0], 7])
            x[19] = 5
            rows.append(x[rng.randint(0, 12) : 39 - rng.randint(0, 7)])
        uid, root = [rng.randrange(25) for _ in rows], rng.choice([1, 4, 25])
        twin = [rng.random() < 0.1 for _ in rows]
        need = 18
        sets = [set(x) for x in rows]
        hits = lambda a, b: [k for k in range(len(rows[a]) - 19) if sum(v in sets[b] for v in rows[a][k : k + 20]) >= need]
        want, ties = {}, set()
        for a in range(40):
            for b in range(40):
                if (uid[a] != uid[b] or twin[a] or twin[b]) and a != b and hits(a, b) and hits(b, a):
                    want.setdefault(a, []).extend(hits(a, b))
                    ties.add((uid[a] % root, uid[b] % root))
        for small in (24, 100):
            monkeypatch.setattr(P, "_SMALL", small)
            got = P.similar_contexts(np.zeros(40, np.int64), np.array(uid), np.array(uid) % root, np.array(twin), np.arange(40) * 1000, [np.array(x, np.uint32).tobytes() for x in rows], 20, 0.8)
            assert P._needed(20, 0.8) <= need < P._needed(20, 0.8) + 1
            spans = {}
            for u, other, first, last in zip(*(x.tolist() for x in got), strict=True):
                i = first // 1000
                assert uid[i] == u and (u % root, other % root) in ties | {(r, r) for r in range(root)}
                spans[i] = min(first % 1000, spans.get(i, (99, 0))[0]), max(last % 1000, spans.get(i, (99, 0))[1])
            for i in range(40):
                if not twin[i]:
                    assert spans.get(i) == ((min(want[i]), max(want[i]) + 19) if i in want else None), (case, small, i)
            join = lambda links: [min(c) for r in range(root) for c in [component(r, links)]]
            assert join({(u % root, o % root) for u, o in zip(got[0].tolist(), got[1].tolist())}) == join(ties)


def component(r, links):
    seen, todo = {r}, [r]
    while todo:
        x = todo.pop()
        new = {b for a, b in links if a == x} | {a for a, b in links if b == x}
        todo += new - seen
        seen |= new
    return seen


def test_empty(spark):
    assert P.passages_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_of_small_classes_are_not_compared_with_every_row(monkeypatch):
    """Of a line that all rows repeat: 300 rows are one class in the end and 60 are similar to none."""
    rows = [[1] * 44 + [1000 + 2 * u, 1001 + 2 * u] for u in range(300)]
    for t in range(60):  # any two of these share one shingle besides the line at most, but none is in one row alone
        rows.append([1] * 38 + [5000 + 4 * ((t - d) % 60) + d - 1 for d in range(1, 5)] + [5000 + 4 * t + d for d in range(4)])
    order = random.Random(6).sample(range(360), 360)
    members = [(u, 900 + u, 0, np.array(rows[u], np.uint32).tobytes()) for u in order]
    compared, stretches = [0], P._stretches
    monkeypatch.setattr(P, "_stretches", lambda hit, *a: compared.__setitem__(0, compared[0] + len(hit)) or stretches(hit, *a))
    found = list(P.group_links(members, 46, 0.8))
    assert {x[0] for x in found} == set(range(300)) and {x[2:] for x in found} == {(0, 45)}
    joined = {0}
    for _ in range(300):
        joined |= {b for a, b, *_ in found if a in joined} | {a for a, b, *_ in found if b in joined}
    assert joined == set(range(300))
    assert compared[0] < 300 * 60


def test_tables_of_few_rows_change_nothing(monkeypatch):
    rng = random.Random(12)
    base = [rng.randrange(1 << 30) for _ in range(40)]
    members = []
    for u in range(150):
        x = list(base) if u % 3 else [rng.randrange(1 << 30) for _ in range(12)] * 3
        for _ in range(rng.randint(0, 8)):
            x[rng.randrange(len(x))] = rng.randrange(1 << 30)
        members.append((u, 500 + u, 0, np.array(x, np.uint32).tobytes()))
    want = sorted(P.group_links(members, 20, 0.8))
    assert want
    monkeypatch.setattr(P, "_TABLE", 1)
    monkeypatch.setattr(P, "_PAIRS", 7)
    assert sorted(P.group_links(members, 20, 0.8)) == want
