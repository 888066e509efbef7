"""PII surrogates: nothing real is left, entities stay distinct and coherent."""
import re

from conftest import SF_SMALL
from tessera.llm import surrogates

FORMS = {"email": r"[\w.]+@[\w.]+\w", "card": r"\b\d{16}\b", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
         "ip": r"\b\d+\.\d+\.\d+\.\d+\b", "secret": r"\b[0-9a-fA-F]{40}\b"}


def luhn(digits):
    ds = [int(c) for c in digits][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def replaced(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, kinds string, id int")
    return {r["doc_id"]: r for r in surrogates.replace_pii(df, **kw).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r for r in surrogates.replace_pii(docs).collect()}
    assert set(out) == set(before)
    swap, real = {}, set()
    for d, text in before.items():
        new = out[d]["text"]
        for kind, form in FORMS.items():
            a, b = re.findall(form, text), re.findall(form, new)
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert [c.isdigit() for c in x] == [c.isdigit() for c in y] or kind == "ip"
                assert swap.setdefault(x.lower(), y.lower()) == y.lower()
            real |= set(a)
        skeleton = re.compile("|".join(FORMS.values()))
        assert skeleton.sub("#", text) == skeleton.sub("#", new)
        assert out[d]["n_entities"] == len(skeleton.findall(text))
    assert len(real) > 10 and len(set(swap.values())) == len(swap)
    assert not {x.lower() for x in real} & set(swap.values())


def test_types_formats_and_coreference(spark):
    card = "4539 1488 0343 6467"
    texts = ["Ann@Site.org and ann@site.org, ANN@SITE.ORG", "+49 (030) 123-4567 or 030-123-4567", card + " / 4539148803436467",
             "1234-5678-9012-3456", "10.0.0.1 10.0.0.2 v1.2.3.4.5", "Mr. John Smith met Mary Smith; Mr Smith. JOHN", "Анна Иванова и Пётр Иванова",
             "a" * 40, "deadbee1" * 5, None, "", "plain text, nothing here 12 345"]
    out = replaced(spark, texts)
    a, b, c = re.findall(r"\S+@[\w.]+\w", out[0]["text"])
    assert a.lower() == b == c.lower() and a[0].isupper() and b.endswith(".org") and c.isupper() and b != "ann@site.org"
    one, two = re.findall(r"[\d()+ -]{10,}\d", out[1]["text"])
    assert one.startswith("+49 (") and re.fullmatch(r"\d{3}-\d{3}-\d{4}", two.strip())
    x, y = out[2]["text"].split(" / ")
    assert x.replace(" ", "") == y and y != card.replace(" ", "") and luhn(y) and y[0] == "4"
    assert luhn("1234567890123456") == luhn(out[3]["text"].replace("-", "")) and re.fullmatch(r"\d{4}(-\d{4}){3}", out[3]["text"])
    ips = out[4]["text"].split(" ")
    assert ips[0] != ips[1] and ips[2] == "v1.2.3.4.5" and all(0 < int(n) < 255 for ip in ips[:2] for n in ip.split("."))
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+); Mr (\w+)\. JOHN", out[5]["text"])
    first, s1, second, s2, s3 = m.groups()
    assert first in surrogates.GIVEN["latin", "m"].split() and first != "John"
    assert second in surrogates.GIVEN["latin", "f"].split() and second != "Mary" and s1 == s2 == s3 != "Smith"
    f, s, _, g, t = out[6]["text"].split()
    assert f in surrogates.GIVEN["cyrillic", "f"] and g in surrogates.GIVEN["cyrillic", "m"] and s == t != "Иванова"
    assert re.fullmatch("[а-я]+", s.lower())
    assert out[7]["text"] == texts[7] and re.fullmatch("[0-9a-f]{40}", out[8]["text"]) and out[8]["text"] != texts[8]
    assert out[9]["text"] is None and out[9]["n_entities"] == 0 and [out[i]["text"] for i in (10, 11)] == texts[10:]
    assert out[5]["kinds"] == ["name"] and out[0]["n_entities"] == 3
    again = replaced(spark, texts)
    assert all(again[i]["text"] == out[i]["text"] for i in out)
    other = replaced(spark, texts, secret="k2")
    assert other[0]["text"] != out[0]["text"]


def test_clashes_are_drawn_again(spark, monkeypatch):
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ["ba", "be"])
    names = [f"Mr. X{chr(97 + i)}{chr(97 + j)}n" for i in range(12) for j in range(5)]
    out = replaced(spark, names)
    assert len({out[i]["text"] for i in out}) == len(names)


def test_repeated_ids_long_texts_and_empty(spark):
    long = "x " * 50_000 + "me@a.bc"
    df = spark.createDataFrame([(1, "me@a.bc"), (1, "me@a.bc"), (1, "none"), (None, long), (None, None)], "doc_id long, text string")
    out = surrogates.replace_pii(df).collect()
    new = {r["text"] for r in out if r["n_entities"] and r["doc_id"]}
    assert len(out) == 5 and len(new) == 1 and {r["text"] for r in out if r["doc_id"] is None} == {None, "x " * 50_000 + new.pop()}
    assert surrogates.replace_pii(df.limit(0)).count() == 0


def test_wide_forms_and_bare_surnames(spark):
    texts = ["call +44 20 7946 0958 or 0049 30 1234567.", "call 5551234567 or 555-123-4567", "m\u00fcller@x.org, o'neil@y.org, \u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.\u0440\u0444",
             "Mary Smith-Jones met John O'Brien.", "John Michael Smith came. Later Smith left; Smith's hat, Smithers too.",
             "Mary Ann Hopkins and Ludwig; Mr John van der Berg", "\u0418\u0432\u0430\u043d \u041f\u0435\u0442\u0440\u043e\u0432\u0438\u0447 \u0421\u0438\u0434\u043e\u0440\u043e\u0432", "in 1700000000 seconds, 3.1415926535 of 12345 678"]
    out = {i: r["text"] for i, r in replaced(spark, texts).items()}
    n = {i: r["n_entities"] for i, r in replaced(spark, texts).items()}
    a, b = re.fullmatch(r"call (\+44 \d\d \d{4} \d{4}) or (00\d\d \d\d \d{7})\.", out[0]).groups()
    assert a != "+44 20 7946 0958" and b != "0049 30 1234567" and n[0] == 2
    c, d = re.fullmatch(r"call (\d{10}) or (\d{3}-\d{3}-\d{4})", out[1]).groups()
    assert c == d.replace("-", "") != "5551234567"
    assert n[2] == 3 and not re.search("m\u00fc|o'n|neil|\u0438\u0432\u0430", out[2])
    assert not re.search("Smith|Jones|Brien|O'", out[3]) and n[3] == 2
    given, middle, sur, again, own = re.fullmatch(r"(\w+) (\w+) (\w+) came\. Later (\w+) left; (\w+)'s hat, Smithers too\.", out[4]).groups()
    assert sur == again == own != "Smith" and given != "John" and middle != "Michael" and n[4] == 3
    assert not re.search("Ann|Hopkins|Berg", out[5]) and " van der " in out[5] and "and Ludwig;" in out[5]
    assert not re.search("\u041f\u0435\u0442\u0440\u043e\u0432|\u0421\u0438\u0434\u043e\u0440", out[6]) and out[7] == texts[7]
