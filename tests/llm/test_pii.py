import hashlib
import random
import re

from tangoflow.llm import pii as P
from tangoflow.llm.common import span_digest


def brute(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (p, ok) in enumerate([
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and P.luhn(digits(s))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return sorted(out)


def texts():
    rng = random.Random(2)
    rows = [None, "", "a@b.c@d.e x", "@a.b@c.d", "a@@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3", "+1 (499) 555-6503-", "+12",
            "4111 1111 1111 1111-4111", "4111-1111-1111-1111 é", "12.5@x.y.z-..", "é@b.c x+y@é.c", "aaa@bbb@ccc.com", "0001.02.3.4",
            "𝒜 me@x.org", "9" * 3000, "a" * 30000 + "@", "+" * 200 + "1 " + "(" * 3000, "1." * 3000]
    parts = ["a", "@", ".", "1", "23", "4111111111111111", "+", "-", " ", "(", ")", "x.com", "é", "%", "255", "\n"]
    return rows + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_base_spans_match_brute_force(docs_of):
    rows = list(enumerate(texts()))
    got = span_digest(P.extract(docs_of(rows + rows[3:5])), ["doc_id"], P.KINDS).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = brute(rows[r.doc_id][1])
        said = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), rows[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in want) for n in range(4))
        assert set(filter(None, said.split(","))) <= set(filter(None, r.spans.split(",")))


def test_patterns_of_seeds_discover_unseen_identifiers(docs_of):
    rows = [(i, f"please call me at phone number +1 499 555 {1000 + i} today") for i in range(20)]
    rows += [(100, "please call me at phone number (212) 555-0188 today"), (101, "the score was 212 555 0188 points"),
             (102, "nothing here")]
    got = {r.doc_id: r for r in P.extract(docs_of(rows)).collect()}
    assert [(s.start, s.stop, s.k) for s in got[100].spans] == [(31, 45, 3)] and not got[100].base
    assert not got[101].spans and not got[102].spans
    learnt = P.learn(P.scan(docs_of(rows))).collect()
    assert {"phone number _", "number _ today", "number _ *"} <= {r.pattern for r in learnt}
    assert all(r.seeds == 20 and r.k == 3 for r in learnt)


def planted():
    """Documents with base identifiers in a few wordings, hidden ones in looser
    forms in the same wordings, and decoys: loose forms in other wordings."""
    rng = random.Random(21)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    wordings = {0: ["my mail is {} please", "write to {} soon", "contact: {}"], 3: ["call me at {} now", "phone: {}", "my number is {} today"],
                1: ["server at {} is down", "host {} answered"]}
    base = {0: lambda: f"{name()}@{name()}.org", 3: lambda: f"+1 {n(3)} {n(3)} {n(4)}", 1: lambda: f"{n(2)}.{n(2)}.{n(2)}.{n(2)}"}
    loose = {0: lambda: f"{name()} (at) {name()}.org", 3: lambda: f"({n(3)}) {n(3)}-{n(4)}", 1: lambda: f"{n(4)}:{n(3)}a:{n(4)}:{n(4)}:{n(4)}:{n(4)}:{n(4)}:{n(4)}"}
    decoys = ["the score was {} points", "table {} shows", "in {} of these", "order {} shipped", "chapter {} begins"]
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(12))
    rows, hidden = [], []
    for i in range(900):
        k = rng.choice((0, 1, 3))
        rows.append((i, f"{filler()} {rng.choice(wordings[k]).format(base[k]())} {filler()}"))
    for i in range(1000, 1200):
        k = rng.choice((0, 1, 3))
        value = loose[k]()
        rows.append((i, f"{filler()} {rng.choice(wordings[k]).format(value)} {filler()}"))
        hidden.append(i)
    for i in range(2000, 2400):
        rows.append((i, f"{filler()} {rng.choice(decoys).format(loose[rng.choice((0, 1, 3))]())} {filler()}"))
    return rows, hidden


def test_planted_identifiers_of_unseen_forms_are_found(docs_of):
    """The README has these figures."""
    rows, hidden = planted()
    got = {r.doc_id: r for r in P.extract(docs_of(rows)).collect()}
    assert all(not got[i].base for i in hidden)
    recall = sum(len(got[i].spans) > 0 for i in hidden) / len(hidden)
    wrong = sum(len(got[i].spans) > len(got[i].base) for i, _ in rows if i not in set(hidden))
    assert recall >= 0.9 and wrong <= 4


def test_a_pattern_of_many_candidates_and_few_seeds_is_refused(docs_of):
    rows = [(i, f"call +1 499 555 {1000 + i} now") for i in range(10)] + [(100 + i, f"call 212 555 {1000 + i} now") for i in range(60)]
    got = {r.doc_id: r for r in P.extract(docs_of(rows)).collect()}
    assert not any(got[i].spans for i in range(100, 160))


def test_words_beside_an_identifier_are_read_whole():
    long = "x" * 5000
    for t in (f"a {long} b 1.2.3.4 {long} c", f"{long} b 1.2.3.4 {long}", f"b 1.2.3.4", "1.2.3.4 x"):
        at = t.index("1.2.3.4")
        assert P._before(t, at, 2) == t[:at].split()[-2:]
        assert P._after(t, at + 7) == (t[at + 7:].split() or [""])[0]


def test_mixed_contexts_are_not_trusted(docs_of):
    rows = [(i, f"write to +1 499 555 {1000 + i} now") for i in range(6)] + [(50 + i, f"write to a{i}@b.org now") for i in range(6)]
    rows += [(100, "write to 212 555 0188 now")]
    got = {r.doc_id: r for r in P.extract(docs_of(rows)).collect()}
    assert not got[100].spans


def test_empty_table(docs_of):
    assert P.extract(docs_of([(1, "")]).where("false")).count() == 0
