import datetime
import hashlib
import random
import re

from geolens.llm import pii

SCHEMA = "doc_id long, text string"


def rewritten(spark, texts, key="k", inverse=False):
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: (r["text"], list(r["pii_kinds"])) for r in pii.pseudonymise(frame, key, inverse=inverse).collect()}


def luhn(number):
    d = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


TEXTS = [
    "Mail Bob.Smith+x@Mail2.example.com or +1 (638) 555-3502, card 4272933927475843 and 4272 9339 2747 5843; ip 26.245.96.15 v 999.1.1.1 born 1999-02-28 not 2023-02-30",
    "bob.smith+x@mail2.example.com, +1 (638) 555-3502! a@b.io 1234567890123456 555-123-4567 4272-9339-2747-5843",
    None, "", "no digits", "é 26.245.96.15é", "0" * 50_000 + " x@y.org", "3782 822463 10005 and 1800-01-01 2199-12-31 1799-12-31 2200-01-01", "1.2.3.4.5 x1.2.3.4 2020-01-01-05",
]


def test_finds_keep_their_format_and_stay_linked(spark):
    got = rewritten(spark, TEXTS)
    a, kinds = got[0]
    b, more = got[1]
    assert kinds == ["email", "phone", "card", "card", "ip", "date"] and more == ["email", "phone", "email", "phone", "card"]
    shape = r"Mail ([a-z]+\.[a-z]+\+[a-z]@[a-z]+\d\.[a-z]+\.com) or (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}); ip ([\d.]+) v 999.1.1.1 born (\d{4}-\d\d-\d\d) not 2023-02-30"
    email, phone, card, spaced, ip, day = re.fullmatch(shape, a).groups()
    assert card == spaced.replace(" ", "") and luhn(card) and card != "4272933927475843"
    assert all(int(x) < 256 for x in ip.split(".")) and ip != "26.245.96.15"
    assert datetime.date(1800, 1, 1) <= datetime.date.fromisoformat(day) <= datetime.date(2199, 12, 31)
    assert email in b and phone in b and card == re.search(r"[\d-]{19}", b)[0].replace("-", "") and "1234567890123456" in b
    assert got[2] == (None, []) and got[3] == ("", []) and got[4] == ("no digits", [])
    assert got[5][1] == ["ip"] and got[6][1] == ["email"] and got[7][1] == ["card", "date", "date"]
    assert ip in got[5][0] and got[7][0].endswith("1799-12-31 2200-01-01")


def test_the_key_undoes_it_and_another_doesn_t(spark):
    done = rewritten(spark, TEXTS)
    back = rewritten(spark, [done[i][0] for i in range(len(TEXTS))], inverse=True)
    assert {i: t for i, (t, _) in back.items()} == {i: t and t.replace("Bob.Smith+x@Mail2", "bob.smith+x@mail2") for i, t in enumerate(TEXTS)}
    assert rewritten(spark, TEXTS[:1], key="other")[0][0] != done[0][0]


def test_permutations_are_one_to_one(spark):
    spark.range(0, 189 * 773).selectExpr(pii.feistel_number("id", 189, 773, "'k'", "date") + " AS v").createOrReplaceTempView("days")
    assert spark.sql("SELECT count(DISTINCT v), min(v), max(v) FROM days").first()[:] == (146_097, 0, 146_096)
    texts = spark.range(0, 1000).selectExpr("lpad(cast(id AS string), 3, '0') AS t").selectExpr(pii.feistel_text("t", "'k'", "x") + " AS v")
    assert texts.distinct().count() == 1000 and texts.where("v rlike '^[0-9]{3}$'").count() == 1000


def test_only_projections(spark):
    frame = spark.createDataFrame([(1, "a@b.io", "own")], SCHEMA + ", pii_kinds string")
    out = pii.pseudonymise(frame, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert out.columns == ["doc_id", "text", "pii_kinds"] and pii.pseudonymise(frame.limit(0), "k").count() == 0


# ---- the same by hand -----------------------------------------------------------

RULES = [
    ("email", r"[\w.%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"),
    ("date", r"(?<![\d-])\d\d\d\d-\d\d-\d\d(?![\d-])"),
    ("card", r"(?<![0-9A-Za-z])(\d{13,19}|(\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])"),
    ("phone", r"(\+\d{1,3}[ .-]?(\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|(?<![0-9A-Za-z])\d{3}[-.]\d{3}[-.]\d{4})(?!\d)"),
]
RULES = [(kind, re.compile(rule, re.A)) for kind, rule in RULES]


def digest(*said):
    return hashlib.sha256("|".join(map(str, said)).encode()).hexdigest()


def text_by_hand(value, key, tweak):
    halves = [value[: len(value) // 2], value[len(value) // 2 :]]
    for r in range(8):
        own, other = r % 2, halves[1 - r % 2]
        stream = digest(key, tweak, r, 0, other) + digest(key, tweak, r, 1, other)
        out = ""
        for i, c in enumerate(halves[own]):
            first, size = next(((f, n) for f, n in (("0", 10), ("a", 26), ("A", 26)) if 0 <= ord(c) - ord(f) < n), (None, 0))
            step = int(stream[i % 32 * 4 :][:4], 16)
            out += chr(ord(first) + (ord(c) - ord(first) + step) % size) if first else c
        halves[own] = out
    return "".join(halves)


def number_by_hand(value, a, b, key, tweak):
    parts, sizes = list(divmod(value, b)), (a, b)
    for r in range(8):
        own = r % 2
        parts[own] = (parts[own] + int(digest(key, tweak, r, parts[1 - own])[:14], 16)) % sizes[own]
    return parts[0] * b + parts[1]


def filled(shape, digits):
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), shape, flags=re.A)


def value_by_hand(kind, m, key):
    """The pseudonym of one find, or None if it isn't valid."""
    digits = re.sub(r"\D", "", m)
    if kind == "email":
        name, _, domain = m.lower().partition("@")
        host, _, last = domain.rpartition(".")
        return f"{text_by_hand(name, key, 'name')}@{text_by_hand(host, key, 'host')}.{last}"
    if kind == "ip":
        octets = [int(o) for o in m.split(".")]
        if max(octets) > 255:
            return None
        return ".".join(map(str, number_by_hand(int.from_bytes(bytes(octets), "big"), 65536, 65536, key, "ip").to_bytes(4, "big")))
    if kind == "date":
        start = datetime.date(1800, 1, 1)
        try:
            day = datetime.date.fromisoformat(m)
        except ValueError:
            return None
        if not 1800 <= day.year <= 2199:
            return None
        return str(start + datetime.timedelta(number_by_hand((day - start).days, 189, 773, key, "date")))
    if kind == "card":
        if not luhn(digits):
            return None
        body = text_by_hand(digits[:-1], key, "card")
        return filled(m, body + next(d for d in "0123456789" if luhn(body + d)))
    if not 10 <= len(digits) <= 15:
        return None
    return filled(m, digits[:-10] + text_by_hand(digits[-10:], key, "phone"))


def by_hand(text, key):
    out, kinds, i = "", [], 0
    while i < len(text):
        kind, hit = next(((k, h) for k, rule in RULES if (h := rule.match(text, i))), (None, None))
        if hit is None:
            out, i = out + text[i], i + 1
            continue
        new = value_by_hand(kind, hit[0], key)
        out, i = out + (hit[0] if new is None else new), hit.end()
        kinds += [kind] * (new is not None)
    return out, kinds


def test_against_a_finder_and_a_permutation_by_hand(spark):
    rng = random.Random(11)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(rng.choice([12, 14, 15, 15, 18]))
        whole = body + next(d for d in "0123456789" if luhn(body + d))
        return " ".join([whole[:4], whole[4:8], whole[8:12], whole[12:]]) if len(whole) == 16 and rng.random() < 0.5 else whole

    makers = [
        card, lambda: number(rng.randint(9, 20)), lambda: ".".join(str(rng.randrange(280)) for _ in range(rng.choice([3, 4, 4, 5]))),
        lambda: f"{rng.randint(1790, 2210)}-{rng.randint(0, 13):02d}-{rng.randint(0, 31):02d}", lambda: f"+{rng.randint(1, 999)} ({number(3)}) {number(3)}-{number(4)}",
        lambda: f"{number(3)}{rng.choice('-.')}{number(3)}{rng.choice('-.')}{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"+{number(2)}{number(3)}.{number(4)}.{number(4)}",
        lambda: "".join(rng.choice("aB9._%+-") for _ in range(rng.randint(1, 9))) + "@" + rng.choice(["x.org", "Mail-2.Example.co.uk", "a.b", "host", "q.io.", "é.de"]),
        lambda: rng.choice(["word", "é", "", "-", ".", "@", "\n", "x" * 70 + "@" + "y" * 70 + ".com"]),
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", " ", ", ", "", "-", "."]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    got = rewritten(spark, texts, "key")
    seen = set()
    for i, text in enumerate(texts):
        assert got[i] == by_hand(text, "key"), text
        seen.update(got[i][1])
    assert seen == {"email", "ip", "date", "card", "phone"}
