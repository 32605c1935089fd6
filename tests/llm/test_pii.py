import random
import re

from sparkrules.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    found = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            found += [(m.start(), k, m.end())] * good
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_against_patterns():
    random.seed(6)
    texts = ["".join(random.choices("ab@.+-0123 456789() 1.2%é", k=random.randint(0, 90))) for _ in range(20_000)]
    texts += [None, "", "4111 1111 1111 1111", "+1 (555) 123-4567.", "x" * 900 + "@", "1" * 900, "1.2.3.4.5.6.7.8", "a@b.c@d.e.f", "+" * 900 + "1 2"]
    for text in texts:
        assert [s[:3] for s in pii.find(text) if s[3]] == brute(text)
    for long in ("x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "one " * 100_000):
        pii.find(long)


def test_disguises_map_back_to_source():
    cases = {
        "mail john.doe (at) example (dot) com now": "john.doe (at) example (dot) com", "reach john at example dot com": "john at example dot com",
        "jоhn@exаmple.com": "jоhn@exаmple.com", "j​ohn@example.com": "j​ohn@example.com", "host 192 dot 168 dot 1 dot 1!": "192 dot 168 dot 1 dot 1",
        "plus one five five five two three four nine eight seven six": "plus one five five five two three four nine eight seven six",
        "＋１ ５５５ １２３ ４５６７ x": "＋１ ５５５ １２３ ４５６７", "no. ٤١١١ 1111 1111 1111": "٤١١١ 1111 1111 1111",
    }
    for text, want in cases.items():
        assert want in [text[a:b] for _, a, b, base in pii.find(text) if not base], text
        assert want not in pii.masked(text)
    for clean in ("they met at noon, the dot on one i", "one two three", "at the end dot dot dot", "look at this (at) once", "ein Éclair à la carte"):
        assert pii.find(clean) == []


def test_tables(spark, tables):
    rows = [(1, "a b.c@d.org +1 555 123 4567"), (2, None), (None, ""), (1, "a b.c@d.org +1 555 123 4567"), (3, "ip 10.0.0.1 " * 3000)]
    docs = tables(rows)
    got = sorted(((r.doc_id, [tuple(x)[:3] for x in r.spans]) for r in pii.scan(docs, "doc_id", "_text", "text.x").collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)
    out = pii.clean(docs)
    assert out.columns == docs.columns
    by_id = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert by_id[1] == ("a [EMAIL] [PHONE]", 17) and by_id[2] == (None, None) and by_id[3][0] == "ip [IP] " * 3000
    assert pii.clean(tables([])).collect() == []


def test_every_disguise_alone():
    signs = [f"{gap}{a}{inner}{word}{inner}{b}{gap}" for word in ("at", "AT", "@") for a, b in zip("([{<", ")]}>") for gap in ("", " ") for inner in ("", " ")]
    dots = [f"{gap}{a}{inner}{word}{inner}{b}{gap}" for word in ("dot", "Dot", ".") for a, b in zip("([{<", ")]}>") for gap in ("", " ") for inner in ("", " ")]
    hidden = [f"alice{c}@example.com" for c in pii.INVISIBLE]
    addresses = [f"alice{x}example.com" for x in (" at ", " AT ", *signs)] + [f"alice@example{x}ch" for x in (" dot ", " DOT ", *dots)] + hidden
    addresses += [f"alice at example{x}{end}" for x in (".", " dot ") for end in ("ch", "pl", "jp", "ca", "at", "museum", "co.uk")]
    for address in addresses:
        for text in (f"mail {address} if need be", address):
            assert address in [text[a:b] for kind, a, b, _ in pii.find(text) if kind == "email"], text
            assert address not in pii.masked(text)
        assert address.isascii() is False or pii.DISGUISE.search(address) and any(h in address.lower() for h in pii.HINTS)
