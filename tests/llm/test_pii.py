import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import pii


def keyed(kind, turn, value):
    return int(hashlib.sha256(f"{pii.KEY}|{kind}|{turn}|{value}".encode()).hexdigest()[:12], 16)


def pair(kind, x, y, a, b):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2 == 0:
            x = (x + keyed(kind, i, y)) % a
        else:
            y = (y + keyed(kind, i, x)) % b
    return x, y


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10


def card(d):
    if luhn(d):
        return d
    n = len(d)
    a, b = (n - 2) // 2, n - 2 - (n - 2) // 2
    x, y = pair(f"card{n}", int(d[1 : 1 + a]), int(d[1 + a : -1]), 10**a, 10**b)
    body = f"{d[0]}{x:0{a}d}{y:0{b}d}"
    return body + str(-luhn(body + "0") % 10)


def phone(m):
    d = re.sub("[^0-9]", "", m)
    area, rest = int(d[-10:-7]), int(d[-7:])
    if area >= 200:
        x, y = pair("phone", area - 200, rest, 800, 10**7)
        x += 200
    else:
        x, y = pair("phone0", area, rest, 200, 10**7)
    new = iter(d[:-10] + f"{x:03d}{y:07d}")
    return re.sub("[0-9]", lambda _: next(new), m)


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return m
    x, y = pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def day(d):
    n = (d - datetime.date(1600, 1, 1)).days
    x, y = pair("day", n % 146097 // 773, n % 146097 % 773, 189, 773)
    return datetime.date(1600, 1, 1) + datetime.timedelta(n // 146097 * 146097 + x * 773 + y)


def one(spark, text):
    return pii.pseudonymize(spark.createDataFrame([(text,)], "text string")).first().text


@pytest.fixture(scope="module")
def many(spark):
    """Values and their pseudonyms, in one job."""

    def run(values):
        df = spark.createDataFrame([(i, f"say {v} now") for i, v in enumerate(values)], "i int, text string")
        return [r.text[4:-4] for r in pii.pseudonymize(df).orderBy("i").collect()]

    return run


def test_numbers_equal_the_reference_network(many):
    cards = ["4012888888881881", "378282246310005", "5555555555554444", "6011000990139424", "4222222222222", "4012888888881882"]
    assert many(cards) == [card(c) for c in cards]
    phones = ["+1 (844) 555-2728", "(911) 555-0000", "068-555-1234", "1 212 555 1234"]
    assert many(phones)[:3] == [phone(p) for p in phones[:3]]
    ips = ["20.194.149.51", "255.255.255.255", "0.0.0.0", "256.1.1.1"]
    assert many(ips) == [ip(x) for x in ips]
    dates = ["2024-02-29", "1999-12-31", "1600-01-01", "9999-12-31"]
    assert many(dates)[:3] == [day(datetime.date.fromisoformat(d)).isoformat() for d in dates[:3]]
    out = many(["2023-02-30", "2023-13-01", "000-12-3456", "666-12-3456", "123-00-3456"])
    assert out == ["2023-02-30", "2023-13-01", "000-12-3456", "666-12-3456", "123-00-3456"]


def test_formats_stay_and_values_link(many):
    a, b, c = many(["4012888888881881", "4012 8888 8888 1881", "4012-8888-8888-1881"])
    assert a == b.replace(" ", "") == c.replace("-", "") != "4012888888881881" and luhn(a) == 0
    d = many(["31/12/1999", "12/31/1999", "31.12.1999", "1999-12-31", "1/2/2003", "2003-02-01"])
    iso = datetime.date.fromisoformat(d[3])
    assert d[0] == iso.strftime("%d/%m/%Y") and d[1] == iso.strftime("%m/%d/%Y") and d[2] == iso.strftime("%d.%m.%Y")
    e = datetime.date.fromisoformat(d[5])
    assert d[4] == f"{e.day}/{e.month}/{e.year}"
    s = many(["123-45-6789", "899-99-9999"])
    assert all(re.fullmatch(r"\d{3}-\d{2}-\d{4}", x) and x[:3] not in ("000", "666") and x[:3] < "900" and x[4:6] != "00" and x[7:] != "0000" for x in s)
    i = many(["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88370400440532013000"])
    assert i[0] == i[1].replace(" ", "") and i[3] == "DE88370400440532013000"
    for x in (i[0], i[2]):
        assert int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
    m = many(["ob.92@mail4.example.com", "OB.92@mail4.example.com", "zz.92@mail4.example.com"])
    assert m[0] == m[1] != m[2] and re.fullmatch(r"[a-z]{2}\.\d{2}@mail4\.example\.com", m[0])


def test_permutations_are_one_to_one(spark):
    p = pii.permute_pair("k", "t", F.floor(F.col("id") / 11), F.col("id") % 11, 13, 11)
    got = spark.range(143).select(p.alias("p")).select("p.x", "p.y").distinct()
    assert got.count() == 143 and got.where("x between 0 and 12 and y between 0 and 10").count() == 143
    texts = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(pii.permute_text("k", "t", F.col("s")).alias("t"))
    assert texts.distinct().count() == 1000 and texts.where(~F.col("t").rlike("^[0-9]{3}$")).count() == 0


def test_rows_without_values_and_odd_rows(spark, edge_docs, clashing_docs, empty_docs):
    for d in (edge_docs, clashing_docs):
        out = pii.pseudonymize(d)
        assert out.columns == d.columns and out.count() == d.count()
        before = {r.doc_id: r.text for r in d.collect()}
        for r in out.collect():
            assert (r.text != before[r.doc_id]) == (r.doc_id == 12)
    text = out.where("doc_id = 12").first().text
    assert "555-2728" not in text and "ob.9@" not in text and "4012888888881881" not in text
    assert pii.pseudonymize(empty_docs).count() == 0


def test_main_path_has_no_python(spark, edge_docs):
    plan = pii.pseudonymize(edge_docs.select("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_values_at_edges_and_long_runs(spark):
    assert one(spark, "4012888888881881") == card("4012888888881881")
    assert one(spark, "x" * 50000 + "@") == "x" * 50000 + "@"
    assert one(spark, "1" * 30000) == "1" * 30000
    both = one(spark, "20.194.149.51, 20.194.149.51.")
    assert both == f"{ip('20.194.149.51')}, {ip('20.194.149.51')}."
