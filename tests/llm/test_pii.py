"""Personal data against the patterns in plain Python, and disclosing terms."""

import hashlib
import random
import re


from docketry.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), list(BASE).index(kind), kind, m.end()) for kind, pattern in BASE.items()
             for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def awkward():
    rng = random.Random(6)
    parts = ["a@b.c", "x@y-._z@a.b.", "aaa@bbb@c.d", "@", "a.b+c%d@e-f.g.h", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.1.1",
             "99999999999999999999.1.1.1", "4111 1111-1111 1111", "4111111111111112", "378282246310005", "+1 (555) 010-9999",
             "+49 30 1234567890123456", "+1", "++12 345 678 90", "é🙂", "12", "-", " ", ".", "\n", "0000-0000-0000", "a@b", "._%+-@x.y"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    return out + ["", None, "1 " * 20000, "a" * 50000, "a@" * 5000, "1." * 5000, "x.y" * 9000 + "@a.b", "9" * 30000, "+1" + " " * 30000]


def test_base_spans_agree_with_the_patterns(spark):
    rows = list(enumerate(awkward()))
    docs = spark.createDataFrame(rows, "i long, t string").repartition(8)
    got = {r.i: r.s for r in docs.select("i", P.told(P.base_spans(docs.t)).alias("s")).collect()}
    for key, text in rows:
        assert got[key] == brute(text), text[:200] if text else text


def corpus():
    rng = random.Random(2)
    common = ["these", "words", "appear", "everywhere", "always"]
    rows = []
    for i in range(60):
        words = [rng.choice(common) for _ in range(20)]
        if i % 6 == 0:
            words += ["kingfisher", "mail", "Boss@Corp.example", f"only{i}"] + (["halcyon"] if i % 12 == 0 else [])
        if i % 20 == 1:
            words.append("halcyon")
        rows.append((i, " ".join(words)))
    return rows


def test_terms_that_disclose_an_entity(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "i long, t string")
    got = {r.id: (P_spans(r.base), P_spans(r.spans)) for r in P.personal_data(docs, P.Disclosure(alpha=2.0)).collect()}
    for key, text in rows:
        base, spans = got[key]
        assert set(base) <= set(spans)
        words = {text[a:b].lower(): kind for kind, a, b in spans}
        if key % 6 == 0:
            assert words.pop("boss@corp.example") == "email" and words.pop("kingfisher") == "removed" and words.pop("mail") == "removed"
            assert words == ({"halcyon": "term"} if key % 12 == 0 else {})
        else:
            assert not words
    rare = P.personal_data(docs, P.Disclosure(support=11)).collect()
    assert all(len(r.spans) == len(r.base) for r in rare)


def P_spans(spans):
    return [(s.kind, s.start, s.end) for s in spans]


def test_sanitised_texts(spark):
    rows = [(i, t, "x", None) for i, t in corpus()] + [
        (900, "ünï call +49 (30) 123-45678 or a@b.co, 4111 1111 1111 1111", "y", 1), (901, None, "z", 1), (902, "", None, 1),
        (None, "ip 10.0.0.1.", "n", 1), (900, "plain", "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, mark int")
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.spans): r.text for r in out.collect()}
    assert len(got) == len(rows)
    assert got[(900, "y")] == "ünï call [PHONE] or [EMAIL], [CARD]" and got[(900, "again")] == "plain"
    assert got[(901, "z")] is None and got[(902, None)] == "" and got[(None, "n")] == "ip [IP]."
    assert "kingfisher" not in got[(0, "x")] and "[EMAIL]" in got[(0, "x")]
    assert P.sanitise(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame(corpus(), "i long, t string")
    P.personal_data(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_query_counts(spark, tmp_path):
    from docketry.llm.queries import op7_pii

    rows = list(enumerate(awkward()[:300]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op7_pii(spark, str(tmp_path)).collect():
        spans = brute(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        counts = [sum(s.startswith(kind + ":") for s in spans.split(",")) for kind in BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_short_names_and_codes_disclose(spark):
    rows = [(i, f"a word of text number{i} to read in") for i in range(40)]
    rows += [(100 + i, f"a note {name} wrote of {mail} in text{i}") for i in range(4)
             for name, mail in (("Ann", "x1@corp.example"),)]
    rows += [(200 + i, f"a note A7 and 王明 of y2@corp.example in text{i}") for i in range(4)]
    got = {r.id: P_spans(r.spans) for r in P.personal_data(spark.createDataFrame(rows, "i long, t string")).collect()}
    for key, text in rows:
        words = {text[a:b] for kind, a, b in got[key] if kind in ("term", "removed")}
        assert {"Ann"} <= words if 100 <= key < 200 else {"A7", "王明"} <= words if key >= 200 else not words
        assert not words & {"a", "of", "in"}
