import datetime
import hashlib
import random
import re

from trailmark.llm import pseudonyms as d

P = d.Permuter(b"k")


def test_permutations():
    for n in (1, 2, 3, 10, 97, 1000, 4099):
        assert sorted(P(i, n, "x") for i in range(n)) == list(range(n))
    assert [P(i, 1000, "x") for i in range(50)] != [P(i, 1000, "y") for i in range(50)] != [d.Permuter(b"l")(i, 1000, "y") for i in range(50)]
    n = 10**17
    assert len({P(i, n, "z") for i in range(2000)}) == 2000 and all(0 <= P(n - 1 - i, n, "z") < n for i in range(200))


def test_formats_stay_valid():
    rng = random.Random(3)
    for _ in range(300):
        body = str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(14))
        whole = body + str(d._luhn(body))
        new = d.card(whole, P)
        assert len(new) == 16 and new[0] == whole[0] and d._luhn(new[:-1]) == int(new[-1])
        spaced = " ".join(whole[i : i + 4] for i in range(0, 16, 4))
        assert d.card(spaced, P).replace(" ", "") == new
        assert d.card(body + str((d._luhn(body) + 1) % 10), P) is None
        s = f"{rng.choice([1, 665, 667, 899, rng.randint(1, 665)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        assert d.ssn(d.ssn(s, P), P) is not None
        account = "".join(rng.choice("0123456789") for _ in range(18))
        i = f"DE{d._iban_check('DE', account):02d}{account}"
        assert d.iban(d.iban(i, P), P) is not None and d.iban(i, P)[:2] == "DE"
        p = f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}"
        assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", d.phone(p, P))
        assert re.sub(r"\D", "", d.phone(p, P))[-10:] == re.sub(r"\D", "", d.phone(re.sub(r"\D", "", p)[-10:-7] + "-" + re.sub(r"\D", "", p)[-7:-4] + "-" + p[-4:], P))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        assert datetime.date.fromisoformat(d.date(day.isoformat(), P))
        assert datetime.datetime.strptime(d.date(f"{day:%d.%m.%Y}", P), "%d.%m.%Y").date() == datetime.date.fromisoformat(d.date(day.isoformat(), P))
    assert d.ssn("666-12-1234", P) is None and d.ssn("000-12-1234", P) is None and d.ip("256.1.1.1", P) is None and d.date("31.02.2020", P) is None and d.date("2020-13-01", P) is None
    assert datetime.datetime.strptime(d.date("12/31/1999", P), "%m/%d/%Y") and int(d.date("12/31/1999", P).split("/")[1]) > 12
    assert re.fullmatch(r"[a-z]{3}\.\d\d@x\.org", d.email("abc.19@x.org", P)) and d.email("ABC.19@x.org", P).lower() == d.email("abc.19@x.org", P)


def test_iban_before_other_words():
    replace = d.Replacer(b"k")
    for old, rest in (("DE89370400440532013000", " BIC COBADEFF"), ("DE89 3704 0044 0532 0130 00", " 2021"), ("GB82WEST12345698765432", " OR"), ("GB82WEST12345698765432", " DE89370400440532013000 END")):
        new, counts = replace(f"IBAN {old}{rest}")
        assert counts[d.KINDS.index("iban")] == (2 if "END" in rest else 1)
        assert new.startswith(f"IBAN {d.iban(old, P)}") and old not in new and new.endswith(rest if "END" not in rest else " END")
    i = f"DE{d._iban_check('DE', '1' * 20):02d}{'1' * 20}"  # not of the length of that country
    assert replace(i) == (i, [0] * len(d.KINDS))


def test_month_first_dates_have_the_same_pseudonyms():
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(i) for i in range(73049)]
    new = [datetime.date.fromisoformat(d.date(x.isoformat(), P)) for x in days]
    assert len({*new}) == len(days)
    for x, y in [*zip(days, new)][::7]:
        if x.day > 12:
            assert datetime.datetime.strptime(d.date(f"{x:%m/%d/%Y}", P), "%m/%d/%Y").date() == y


def test_documents(spark):
    rows = [
        (1, "Call +1 (743) 555-3824 or 743-555-3824, card 4111 1111 1111 1111.", "x"),
        (2, "card 4111111111111111 12 on 2024-02-29; ip 10.0.0.1 and 1.2.3.4.5 and 300.1.1.1", "x"),
        (3, None, "x"),
        (4, "", "x"),
        (5, "é clean 1234567890123456 text 12", "x"),
        (6, "a.b@mail.example.com " * 3000, "x"),
    ]
    out = {r.doc_id: r for r in d.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, _pi string")).collect()}
    assert out[1]._pii == {"phone": 2, "card": 1} and out[2]._pii == {"card": 1, "date": 1, "ip": 1}
    a, b = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", out[1].text)[0], re.findall(r"or (\d{3})-(\d{3})-(\d{4})", out[1].text)[0]
    assert a == b != ("743", "555", "3824")
    assert re.findall("card ([0-9 ]+)", out[1].text)[0].replace(" ", "") == re.findall("card ([0-9]+)", out[2].text)[0] != "4111111111111111"
    assert "1.2.3.4.5" in out[2].text and "300.1.1.1" in out[2].text
    assert out[3].text is None and out[4].text == "" and out[5].text == rows[4][1] and out[5]._pii == {}
    assert len(set(out[6].text.split())) == 1 and out[6]._pii == {"email": 3000}
    assert d.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, _pi string").limit(0)).count() == 0


def test_whole_table(spark):
    rows = d.op1_feistel_pseudonyms(spark, "/root/testdata/sf0.01").collect()
    old = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(old)
    changed = [r for r in rows if r.text != old[r.doc_id]]
    assert len(changed) > 40
    for r in changed:
        for m in d.PATTERN.finditer(old[r.doc_id]):
            assert m[0] not in r.text or d.Replacer(d.KEY)(m[0])[0] == m[0]


def naive_round(key, name, i, half, size):
    seed = hashlib.blake2b(f"{name}|{i}|".encode() + half, key=key).digest()
    return seed[:size] if size <= 64 else hashlib.shake_256(seed).digest(size)


def naive_number(value, n, name, key):
    """The permutation by plain integers: walks until the value is within range(n)."""
    a = max(2, int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() // 2))
    b = -(-n // a)
    while True:
        x, y = value // b, value % b
        for i in range(8):
            h = int.from_bytes(naive_round(key, f"{name}|{n}", i, str(y if i % 2 == 0 else x).encode(), 24), "big")
            x, y = ((x + h) % a, y) if i % 2 == 0 else (x, (y + h) % b)
        value = x * b + y
        if value < n:
            return value


def naive_digits(value, bases, name, key):
    m = len(bases) // 2
    parts, sizes = [value[:m], value[m:]], [bases[:m], bases[m:]]
    for i in range(8):
        noise = naive_round(key, f"{name}|{len(bases)}", i, bytes(parts[(i + 1) % 2]), 4 * len(sizes[i % 2]))
        parts[i % 2] = [(v + int.from_bytes(noise[4 * j : 4 * j + 4], "little")) % n for j, (v, n) in enumerate(zip(parts[i % 2], sizes[i % 2]))]
    return parts[0] + parts[1]


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def naive(kind, text, key):
    """The pseudonym of one value that is known to be of its kind."""
    if kind == "ip":
        n = sum(int(x) << (24 - 8 * i) for i, x in enumerate(text.split(".")))
        n = naive_number(n, 1 << 32, "ip", key)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        m = len(text) - 2
        body = text[0] + f"{naive_number(int(text[1:-1]), 10**m, f'card{text[0]}', key):0{m}d}"
        return next(body + str(c) for c in range(10) if luhn_ok(body + str(c)))
    if kind == "ssn":
        all_of = [x for x in range(1, 900) if x != 666]
        a, g, s = (int(x) for x in text.split("-"))
        n = naive_number((all_of.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn", key)
        return f"{all_of[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "email":
        local, domain = text.split("@")
        shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in local)
        new = iter(naive_digits([int(c, 36) - (10 if c.isalpha() else 0) for c in local if c.isalnum()], [10 if c.isdigit() else 26 for c in local if c.isalnum()], f"email{shape}@{domain}", key))
        return "".join(c if not c.isalnum() else str(next(new)) if c.isdigit() else chr(97 + next(new)) for c in local) + "@" + domain
    day = datetime.date.fromisoformat(text)
    n = (day - datetime.date(1900, 1, 1)).days
    while True:
        n = naive_number(n, 73049, "date", key)
        new = datetime.date(1900, 1, 1) + datetime.timedelta(n)
        if (new.day > 12) == (day.day > 12):
            return new.isoformat()


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = {
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": lambda: next(x for x in iter(lambda: "4" + digits(15), "") if luhn_ok(x)),
        "ssn": lambda: f"{rng.randint(1, 600):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "email": lambda: "".join(rng.choice("abcxyz0189._") for _ in range(rng.randint(1, 30))) + "@mail.example.org",
        "date": lambda: (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))).isoformat(),
    }
    known = [(k, f()) for k, f in make.items() for _ in range(8)]
    fillers = ["plain words", "no 666-12-1234 here", "999.1.1.1", "2024-13-45", "4000000000000001", "\n", "über"]
    rows, want = [], {}
    for i in range(60):
        parts = [rng.choice(known) if rng.random() < 0.6 else ("", rng.choice(fillers)) for _ in range(rng.randint(1, 9))]
        rows.append((i, " ; ".join(x for _, x in parts)))
        want[i] = " ; ".join(naive(k, x, d.KEY) if k else x for k, x in parts), [sum(k == kind for k, _ in parts) for kind in make]
    spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in d.op1_feistel_pseudonyms(spark, str(tmp_path)).collect()}
    assert len(got) == 62 and got[100].text is None and got[101].text == ""
    for i, (text, counts) in want.items():
        assert (got[i].text, [got[i][f"n_{k}"] for k in make]) == (text, counts)


def test_long_values_are_permuted_whole(spark):
    assert len({tuple(P.digits([a, b], [26, 10], "x")) for a in range(26) for b in range(10)}) == 260
    a, b = (d.email("b" * 119 + c + "@x.org", P) for c in "bc")
    assert sum(x == y for x, y in zip(a[:120], b[:120])) < 30 and sum(x == "b" for x in a[:120]) < 30
    texts = ["c" * 100_000 + "@x.org", "DE1" * 50_000, "1" * 300_000, "1.2." * 100_000]
    out = d.pseudonymise(spark.createDataFrame([(t, 1) for t in texts], "text string, _PII int")).collect()
    assert [len(r.text) for r in out] == [len(t) for t in texts] and out[0].text[:99_000] != texts[0][:99_000]
    assert sum(x == "c" for x in out[0].text[:100_000]) < 8000 and [r.text for r in out[1:]] == texts[1:]
    assert out[0]._pii == {"email": 1}
