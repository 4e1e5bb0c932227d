import hashlib
import random
import re

from corvane.llm import pii

from .conftest import ROWS, frame

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p.lstrip("0")[:9] or 0) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    return {k: [m.span() for m in re.finditer(r, text) if passes(k, m.group())] for k, r in RAW.items()}


def test_base_spans_equal_the_patterns():
    random.seed(5)
    alphabets = ["0123456789. -", "abc@.-_9 ", "+()0123456789 .-", "a@b.c_"]
    texts = ["".join(random.choice(random.choice(alphabets)) for _ in range(random.randint(0, 80))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.256", "٣.1.2.3.4 é@b.co", "0" * 4500 + ".1.1.1", "9" * 3000]
    assert [t for t in texts if pii.base_spans(t) != brute(t)] == []


def word():
    return "".join(random.choice("abcdefgh") for _ in range(5))


def test_contexts_discover_unseen_identifiers(spark):
    random.seed(1)
    rows = []
    for i in range(60):
        seen = i < 50
        phone = f"{'+1 ' if seen else ''}({random.randint(200, 999)}) 555-{random.randint(1000, 9999)}"
        email = f"{word()}@{word()}" + (".com" if seen else "")
        rows.append((i, f"{word()} please call {phone} {word()} {word()} or write to {email} {word()} room {random.randint(10000, 99999)} {word()} the {random.randint(10000, 99999)}"))
    found = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for i, text in rows:
        added = [(s.kind, text[s.start : s.end]) for s in found[i].added]
        assert len(added) == (0 if i < 50 else 2)
        assert all("555" in s if kind == "phone" else "@" in s for kind, s in added)


def brute_query(rows):
    """All columns of the query by plain loops: base spans by the raw patterns, the graph as dictionaries."""
    found = []  # row, start, end, string, kind, patterns
    for row, (_, text) in enumerate(rows):
        text = text or ""
        base = sorted((a, b, k) for k, spans in brute(text).items() for a, b in spans)
        for a, b, kind in base:
            found.append((row, a, b, text[a:b], kind, pii.contexts(text, a, b)))
        for m in pii.TOKEN.finditer(text):
            string = m.group().strip(pii.TRIM) if m.group()[0] != "(" else m.group().rstrip(pii.TRIM)
            a = m.start() + m.group().index(string)
            b = a + len(string)
            if len(string) >= 4 and not any(x < b and a < y for x, y, _ in base):
                found.append((row, a, b, string, None, pii.contexts(text, a, b)))
    kinds = {}
    for _, _, _, string, kind, patterns in found:
        for pattern in patterns:
            kinds[string, pattern] = max(kinds.get((string, pattern)) or "", kind or "") or None
    seeds = {(s, k) for (s, _), k in kinds.items() if k}
    shapes = {(k, pii.shape(s)) for s, k in seeds}
    scores, accepted = {seed: 1.0 for seed in seeds}, {}
    for _ in range(pii.ROUNDS):
        confidence = {}
        for pattern in {p for _, p in kinds}:
            strings = {s for s, p in kinds if p == pattern}
            for kind in pii.KINDS:
                known = [scores[s, kind] for s in strings if (s, kind) in scores]
                if len(known) >= pii.SUPPORT and len(strings) >= pii.SUPPORT and sum(known) / (len(strings) + pii.PRIOR) >= pii.CONFIDENT:
                    confidence[pattern, kind] = sum(known) / (len(strings) + pii.PRIOR)
        miss = {}
        for (string, pattern), own in kinds.items():
            for kind in pii.KINDS:
                if own is None and (pattern, kind) in confidence:
                    miss[string, kind] = miss.get((string, kind), 1.0) * (1 - min(confidence[pattern, kind], 0.999))
        best = {}
        for (string, kind), m in miss.items():
            best[string] = max(best.get(string, (0.0, "")), ((1 - m) * (1.0 if (kind, pii.shape(string)) in shapes else pii.UNLIKE), kind))
        accepted = {s: (v, k) for s, (v, k) in best.items() if all(s != x for x, _ in seeds)}
        scores = {seed: 1.0 for seed in seeds} | {(s, k): v for s, (v, k) in accepted.items() if v >= pii.CONFIDENT}
    out = []
    for row, (doc_id, text) in enumerate(rows):
        base = brute(text or "")
        added = [(accepted[s][1], a, b) for r, a, b, s, k, _ in found if r == row and k is None and accepted.get(s, (0, ""))[0] >= pii.ACCEPT]
        order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), *x[1:])))
        own = [(k, a, b) for k in pii.KINDS for a, b in base[k]]
        out.append((doc_id, *[len(base[k]) for k in pii.KINDS], hashlib.sha256(order(own).encode()).hexdigest(), order(own + added), len(added)))
    return sorted(out, key=str)


def test_whole_query_by_brute_force(spark, tmp_path):
    random.seed(8)
    rows = [(None, None), (-1, ""), (-2, "a@b.org " * 30)]
    for i in range(58):
        seen = i < 50
        phone = f"{'+1 ' if seen else ''}({random.randint(200, 999)}) 555-{random.randint(1000, 9999)}"
        email = f"{word()}@{word()}" + (".com" if seen else "") + ("x" * 300 if i % 25 == 0 else "")
        rows.append((i, f"{word()} please call {phone} {word()} or write to {email} {word()} host 10.0.{i}.{i % 7} room {random.randint(10000, 99999)}, see X{i}9Z {word()}."))
    frame(spark, rows).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, pii.query(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_query(rows) and sum(r[-1] for r in got) == 16


def test_long_identifiers_never_merge_and_every_overlap_counts():
    a, b = "x" * 500 + "1@h", "x" * 500 + "2@h"
    (one,), (two,) = pii.occurrences(f"mail {a} now"), pii.occurrences(f"mail {b} now")
    assert one[2] != two[2] and one[1] - one[0] == len(a)
    text = "1.1.1.1_2.2.2.2_3.3.3.3_4.4.4.4_5.5.5.5_6.6.6.6"
    assert [o[3] for o in pii.occurrences(text)] == ["ip"] * 6


def test_common_words_reveal_nothing(spark):
    random.seed(2)
    rows = [(i, f"the {word()}@{word()}.com the {random.randint(1000, 9999)} the 10.0.0.{i % 200} the X{i}9") for i in range(80)]
    assert all(not r.added for r in pii.find_personal_data(frame(spark, rows)).collect())


def test_odd_and_empty(spark, odd, empty, tmp_path):
    odd.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    one = next(r for r in got if r.doc_id == 6)
    assert (one.n_email, one.n_phone, one.n_ip, one.n_card) == (1, 1, 0, 0) and one.spans == "email:5:14,phone:18:35"
    assert pii.find_personal_data(empty).count() == 0


def test_redaction():
    assert pii.redact("mail a@b.c now", [("email", 5, 10)]) == "mail [EMAIL] now"
    assert pii.redact("0123456789", [("ip", 2, 6), ("card", 4, 8)]) == "01[IP]89"
