"""Operators 2 and 10 against the patterns as they stand, the lexer, and the co-occurrence counts."""

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from stratalode.llm import pii, secrets
from stratalode.llm import spans as S


def plain_secrets(t):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def plain_personal(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PARTS = ["a", "b", "@", "@x.y", ".", "-", "1", "23", "4111111111111111", " ", "+", "+1", "(", "5.5.5.5", "999", "255", "password", "Token", "apikey", "api_key", "SECRET", "=", ":", '"', "'", "AKIA", "ABCDEF0123456789", "abcdef0123", "deadbeef" * 4, "\n", "é", "ſecret", "%", "_"]


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    for _ in range(5_000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 16)))
        assert sorted(S.secrets(t)) == sorted(plain_secrets(t)), t
        assert sorted(S.personal(t)) == sorted(plain_personal(t)), t


@pytest.mark.parametrize("t", ["a" * 200_000, "1" * 200_000, "a=b" * 60_000, "." * 200_000 + "@", "1." * 100_000, '"' * 100_000, "a@" * 100_000, "x: " * 60_000, " @b.c" * 80_000, "x=" + "+".join(["'ab'"] * 40_000), "a='x'\n" + "a=a+a\n" * 30_000 + "password=a", "".join(f"s{i + 1}=s{i}+'k{i}'\npassword=s{i}\n" for i in range(8_000))])
def test_long_runs_take_linear_time(t):
    began = time.process_time()
    S.secrets(t)
    S.personal(t)
    secrets.literals(t)
    assert time.process_time() - began < 8


def test_lexer_propagates_constants():
    def found(t):
        return [t[a:b] for a, b, _ in secrets.literals(t)]

    assert found('pw = "Zk3$9fLq21xx"\ndb_password = pw\n') == ["Zk3$9fLq21xx"]
    assert found('a = "abcd1234"; b = "EFGH5678"; api_key = a + b') == ["abcd1234", "EFGH5678"]
    assert found('{"secret": "s3cr3tV@lue99"}') == ["s3cr3tV@lue99"]
    assert found("config[\"password\"] = 'hunter2hunter2'") == ["hunter2hunter2"]
    assert found("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCY") == ["wJalrXUtnFEMIK7MDENGbPxRfiCY"]
    for t in ("token: the quick", 'password = "changeme123"', "http://x.y:80/", 'password := os.getenv("X")', 'color = "Zk3$9fLq21xx"', "", "="):
        assert found(t) == []


def test_lexer_reads_typed_declarations_and_long_names_and_values():
    def found(t):
        return [t[a:b] for a, b, _ in secrets.literals(t)]

    for t in ('password: str = "Zk3$9fLq21xx"', 'const apiKey: string = "Zk3$9fLq21xx";', 'let secret: &str = "Zk3$9fLq21xx";', 'token: Optional[str] | None = "Zk3$9fLq21xx"'):
        assert found(t) == ["Zk3$9fLq21xx"], t
    assert found("x" * 5_000 + '_password = "Zk3$9fLq21xx"') == ["Zk3$9fLq21xx"]
    long = "Zk3$9fLq21xx" * 20_000
    assert found(f'a = "{long}"\npassword = a') == [long]


def test_literal_spans_by_brute_force():
    """Random programs of assignments; the plain way substitutes whole values and keeps every origin."""
    rng = random.Random(6)
    names = ["a", "b", "c", "color", "db_password", "api_key", "x.secret", "title"]
    for _ in range(400):
        text, env, want = "", {}, {}
        for _ in range(rng.randrange(1, 12)):
            name = rng.choice(names)
            text += name + rng.choice([" = ", ": ", "=", " := ", ": str = "])
            value, origins, quoted = "", [], False
            for k in range(n := rng.randrange(1, 4)):
                if env and rng.random() < 0.5:
                    other = rng.choice(sorted(env))
                    text += other
                    value, origins, quoted = value + env[other][0], origins + env[other][1], quoted or env[other][2]
                else:
                    s = rng.choice(["Zk3$9fLq21xx", "changeme", "hello world again", "aaaaaaaaaa", "q7", "", "Qw8!zz-12.Xy"])
                    text += '"'
                    value, origins, quoted = value + s, origins + [(len(text), len(text) + len(s))], True
                    text += s + '"'
                text += rng.choice([" + ", "+"]) if k < n - 1 else "\n"
            if not value:
                continue
            env[name] = (value, origins, quoted)
            plain = secrets.Value()
            plain.literal(0, 0, value, quoted)
            weight, score = secrets.name_score(name), plain.score()
            if weight and score >= 0.5 and weight + score >= secrets.THRESHOLD:
                for span in origins:
                    if span[1] > span[0]:
                        want.setdefault(span, weight + score)
        got = {(a, b): s for a, b, s in secrets.literals(text)}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got), text


def test_op2_rows(odd, none, spark):
    rows = [(10, 'pw = "Zk3$9fLq21xx"; db_password = pw; token=abcdefgh1234 AKIAABCDEFGHIJKL ' + "0a" * 16), (11, None)]
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    t = rows[0][1]
    base = sorted(plain_secrets(t), key=lambda s: s[1])
    assert (got[10].n_assign, got[10].n_access, got[10].n_hex) == (1, 1, 1)
    assert got[10].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert got[10].spans.startswith("literal:6:18,assign:") and got[11].spans == "" and got[11].n_assign == 0
    assert secrets.digests(secrets.scan(odd)).count() == odd.count() and secrets.scan(none).count() == 0
    assert set(odd.columns) <= set(secrets.scan(odd).columns)
    assert secrets.redact(spark.createDataFrame([(1, "token=abcdefgh1234 ok")], "doc_id long, text string")).first().text == "[SECRET] ok"


def test_op10_terms_by_brute_force(spark):
    # "zorbla" stands only by one address, in differing lines; "common" stands everywhere.
    fill = ["red", "blue", "green", "grey", "black", "white", "brown", "pink"]
    texts = [f"{w} common zorbla ann@x.org common {w}" for w in fill] + [f"common {w} words and common things for bob{i}@y.org {w}" for i, w in enumerate(fill)] + ["common plain text without data"] * 30 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.term: r.ratio for r in pii.disclosing_terms(docs).collect()}
    assert "zorbla" in terms and "common" not in terms
    # The ratio by its definition.
    import math

    words = [w.lower() for t in texts if t for w in pii.TERM.findall(t)]
    n_entity = 8
    both, total = 8, words.count("zorbla")
    assert abs(terms["zorbla"] - (1 + math.log(both / total) / -math.log(n_entity / len(words)))) < 1e-9
    rows = {r.doc_id: r for r in pii.digests(pii.scan(docs)).collect()}
    assert rows[0].n_email == 1 and rows[0].n_term >= 1 and "term:11:17" in rows[0].spans
    assert rows[20].spans == "" and rows[46].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "ann@x.org" not in clean[0] and "[EMAIL]" in clean[0] and "zorbla" not in clean[0] and clean[20] == texts[20] and clean[46] == ""


@pytest.mark.parametrize("most", [1_000, 0])
def test_op10_query_finds_planted_terms(spark, words, tmp_path, monkeypatch, most):
    """The query and the masking, also where the terms are too many to broadcast."""
    from stratalode.llm import queries

    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    texts = [f"{words(30)}\n{words(2)} Quillon ann@x.org, {words(3)}\n{words(20)}" for _ in range(5)]
    texts += [f"{words(40)}\nfor Dr. Hugo Brandt, OBFU {words(4)}\n{words(20)} Quillon" if i == 0 else f"{words(40)}\nwith Mr Hugo Brandt, OBFU {words(5)}" for i in range(5)]
    texts += [words(70) for _ in range(120)] + [None, "", texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\b(Quillon|OBFU)\b", t)]
        want += [f"name:{m.start(1)}:{m.end(1)}" for m in re.finditer(r"(?:Dr\.|Mr) (Hugo Brandt)", t)]
        assert set(want) <= set(rows[i].spans.split(",")), t
        assert rows[i].n_email == t.count("@") and rows[i].n_name == t.count("Hugo Brandt")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, remove_at=1.1).collect()}  # nothing is removed, all is generalised
    assert "[NAME] [EMAIL]" in clean[0] and "Dr. [NAME], [ACRONYM]" in clean[5] and clean[5].endswith("[NAME]") and clean[130] == ""
    gone = pii.sanitise(docs, remove_at=0.9).filter("doc_id = 5").first().text
    assert "OBFU" not in gone and "[ACRONYM]" not in gone


def test_names_by_address_and_field():
    def found(t):
        return [t[a:b] for a, b in pii.names(t)]

    assert found("Dear Dr. Ann Smithson, name: Émile Zola; Mr Bean and Herr Müller-Lüdenscheidt") == ["Ann Smithson", "Émile Zola", "Bean", "Müller-Lüdenscheidt"]
    assert found("{'patient': 'Bob Ross'}") == ["Bob Ross"]
    for t in ("Drawn Together", "the name of Ann", "name: lower case", "", "Mr.", "filename: Readme"):
        assert found(t) == [], t


def test_near_copies_disclose_nothing(spark):
    docs = spark.createDataFrame([(i, "the quaint vellichor hired ann@x.org last spring") for i in range(40)] + [(99, "other text")], "doc_id long, text string")
    assert pii.disclosing_terms(docs).count() == 0


def test_fixed_names_beside_an_address_disclose_it(spark, words):
    # Only the first name and the surname stand by the address, in independent documents; a line copied with its document is one.
    texts = [f"{words(60)}\nAnn Smithson <ann@x.org>\n{words(60)}" for _ in range(4)]
    texts += [f"{words(60)}\nBea Quillon <bea@y.org>\n{words(60)}" for _ in range(2)]
    copy = words(120)
    texts += [f"{copy}\nCyd Vellich <cyd@z.org>\n{words(1)}" for _ in range(6)] + [f"{words(90)}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.term: r.ratio for r in pii.disclosing_terms(docs).collect()}
    assert terms["ann"] == terms["smithson"] == 1
    n = sum(len(pii.TERM.findall(t)) for t in texts)
    for name in ("bea", "quillon"):  # rated with the missing third context
        assert abs(terms[name] - (1 + math.log(2 / 3) / -math.log(2 / n))) < 1e-9
    assert not {"cyd", "vellich"} & set(terms)


@pytest.mark.parametrize("fixed", [("ann", "smithson"), ("quaint", "zorbla")])
def test_support_does_not_hang_on_hashes(spark, words, fixed):
    fill = ["red", "blue", "green", "grey", "black", "white", "brown", "pink"]
    texts = [f"{' '.join(c)} {' '.join(fixed)} ann@x.org" for c in itertools.combinations(fill, 3)] + [words(50) for _ in range(100)]
    terms = {r.term for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert set(fixed) <= terms


def test_op10_odd_rows(odd, none, spark):
    assert pii.digests(pii.scan(odd)).count() == odd.count()
    assert pii.scan(none).count() == 0 and pii.sanitise(none).count() == 0
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == odd.count()
