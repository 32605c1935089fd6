import random
import re

from sparkrules.llm import paragraphs as p

random.seed(9)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(2, 8))) for _ in range(600)]


def line(n):
    return " ".join(random.choices(VOCAB, k=n))


def edited(text, n):
    w = text.split()
    for k in random.sample(range(len(w)), n):
        w[k] = random.choice(VOCAB)
    return " ".join(w)


def brute(rows):
    found = [(i, n, frozenset(zip(*(w[k:] for k in range(5))))) for i, t in rows for n, _, _, w in p.lines(t or "")]
    order = sorted(range(len(found)), key=lambda k: (found[k][0] is None, found[k][0] or 0, found[k][1]))
    found, top = [found[k] for k in order], list(range(len(found)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for b in range(len(found)):
        for a in range(b):
            x, y = found[a][2], found[b][2]
            if 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = find(a), find(b)
                top[max(a_, b_)] = min(a_, b_)
    sizes = [sum(find(b) == find(a) for b in range(len(found))) for a in range(len(found))]
    return sorted((found[a][:2] + found[find(a)][:2] for a in range(len(found)) if sizes[a] > 1), key=str)


def test_tuning():
    bands, rows = p.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands <= p.MOST_BANDS


def test_against_brute_force(tables):
    base = [line(random.randint(60, 90)) for _ in range(6)]
    family = [edited(base[0], random.randint(0, 2)) for _ in range(40)]
    chain = [base[1]]
    for _ in range(6):
        chain.append(edited(chain[-1], 1))
    texts = ["\n".join([line(30), x, line(5), line(25)]) for x in family + chain + base[2:4]]
    texts += [base[4] + "\n" + base[4].upper(), "", None, "short line\nshort line", base[5] + " " + line(90), line(30_000), "x " * 3000 + "\n" + "x " * 500]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[5])]
    got = sorted(((r.doc_id, r.line, r.cluster_doc_id, r.cluster_line) for r in p.clusters(tables(rows)).collect()), key=str)
    assert got == brute(rows)


def test_offsets_and_empty_tables(tables):
    text = "é short\n" + line(20) + "\n\n" + line(12)
    assert [text[a:b].lower().encode().split() == w for _, a, b, w in p.lines(text)] == [True, True]
    assert p.clusters(tables([])).collect() == []
    assert p.clusters(tables([(1, line(40)), (2, line(40))])).collect() == []


def covered(spans, a, b):
    return any(x <= a and b <= y for x, y in spans)


def test_passages_inside_unlike_lines(tables):
    shared, short = line(60), line(20)
    mixed = lambda text: f"{line(80)} {text} {line(90)}"
    texts = [mixed(shared), mixed(shared.upper()), mixed(short), mixed(short), mixed(shared.replace(" ", "\n", 30)), mixed(line(60)), "é " + mixed(shared)]
    assert p.clusters(tables([*enumerate(texts)])).collect() == []
    got = p.removals(tables([*enumerate(texts), (4, texts[4]), (None, texts[1])])).collect()
    assert {r.doc_id for r in got} == {1, 4, 6, None} and {r.cluster_doc_id for r in got} <= {0, 1}
    for r in got:
        text = texts[1 if r.doc_id is None else r.doc_id]
        gone, kept = text[r.start : r.end].lower().split(), texts[r.cluster_doc_id].lower()
        assert len(gone) >= p.PIECE and " ".join(gone) in kept and text[: r.start].count("\n") == r.line


def test_passages_equal_brute_force_of_pieces(tables):
    common = [line(random.randint(50, 120)) for _ in range(5)]
    texts = [" ".join(random.choice([line(30), x[: random.randint(0, 3)] + " " + x]) for x in random.choices(common, k=4)) for _ in range(30)]
    rows = [*enumerate(texts), (99, "x " * 400)]
    got = p.removals(tables(rows)).collect()
    words = {i: t.split() for i, t in rows}
    seen, first = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            seen.setdefault(" ".join(words[i][k : k + 50]), []).append((i, k))
    lost = {i: [(r.start, r.end) for r in got if r.doc_id == i] for i in words}
    for places in seen.values():
        for i, k in places[1:]:
            if i == places[0][0]:
                continue
            # some piece of every repeated stretch of 50 words is gone, whole
            at = [m.start() for m in re.finditer(r"\S+", dict(rows)[i])] + [len(dict(rows)[i]) + 1]
            assert any(covered(lost[i], at[j], at[j + 25] - 1) for j in range(k, k + 26))
    assert min(a for a, _ in lost[99]) >= 49  # the first of what a text repeats stays


def test_pieces_next_to_a_removed_line(tables):
    shared, whole = line(60), line(40)
    rows = [(1, whole), (2, f"{whole}\n{line(30)} {shared}"), (3, f"{line(70)} {shared} {line(20)}"), (4, f"{line(50)}\n{whole}")]
    got = sorted((r.doc_id, r.line, r.cluster_doc_id, r.cluster_line) for r in p.removals(tables(rows)).collect())
    assert got == [(2, 0, 1, 0), (3, 0, 2, 1), (4, 1, 1, 0)]
