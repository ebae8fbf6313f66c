"""What the secret lexer reads, its time on hostile texts, and the base spans against the rule as stated."""

import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from cairngraph.llm import catalogue, lexer, secrets

LONG = "Zk39fjQ81lsPq02M"


def literals(text):
    return [text[a:b] for _, a, b in secrets.scan(text)[1]]


@pytest.mark.parametrize(
    "text",
    [
        f'password = "abc" + "{LONG}"',
        f'password = (\n    "{LONG}"\n)',
        f'password = (\n    "abc"\n    "{LONG}"  \n)',
        f'password = \n    "{LONG}"',
        f'password = """{LONG}"""',
        f"password = '''\n{LONG}\n'''",
        f"db:\n  password: |\n    {LONG}\n  user: x",
        f"password: >-\n  {LONG}\n",
        f'<add key="password" value="{LONG}"/>',
        f'<setting name="ApiKey" id="1" value="{LONG}"></setting>',
        f"<password>{LONG}</password>",
        f"const password = `{LONG}`;",
        f'{{"a": {{"client_secret": "{LONG}"}}}}',
        f"[db]\npassword = {LONG}",
        f"export API_KEY={LONG}",
        f"run --db-password={LONG}",
        f'password: str = "{LONG}"',
        f'password := "{LONG}"',
        f'config["password"] = "{LONG}"',
        f'#define PASSWORD "{LONG}"',
        f'password = b"{LONG}"',
        f'options = {{password => "{LONG}"}}',
        f'x = "{LONG}"\ny = x\nclient.secret = y',
        f"don't say password = '{LONG}'",
        f'url = "https://host/?token={LONG}"',
        f"url = https://host/?a=1&token={LONG}&b=2",
    ],
)
def test_literals_of_sensitive_names_are_found(text):
    assert LONG in literals(text)


@pytest.mark.parametrize(
    "text",
    [f'colour = "{LONG}"', f'if password == "{LONG}": pass', 'password = "changeme"', "password: ", 'password = """', "password = |\n", "the key: value of this", f"<title>{LONG}</title>", 'password = "two words here"', ""],
)
def test_other_literals_are_left_alone(text):
    assert literals(text) == []


def test_quotes_are_left_out_of_spans():
    assert literals(f"password = `{LONG}`") == [LONG] and literals(f"password = '''{LONG}'''") == [LONG]


@pytest.mark.parametrize(
    "unit,head,tail",
    [
        ("a", "", " x=1"), ("a", "password", ""), ("a-", "", ""), ("\\\"", 'password="', ""), ('a="', "", ""), ("b+", "password=", ""), ("b + ", "password=", ""),
        ("'", "password=", ""), ('"""', "password=", ""), ("`", "password=", ""), ("\n", "password=(", ""), (" ", "password", ""), ("<a b='", "password", ""), ("-", "password", ""),
        ("k: |\n", "password", ""), ("password:", "", ""), ("[", "password", ""), ("\"a b ", "password", ""), ("password=\n", "", ""), ("a='\\'", "key", ""), ("#define ", "key", ""),
    ],
)
def test_a_megabyte_of_anything_takes_about_a_second(unit, head, tail):
    def seconds(n):
        text, start = head + unit * (n // len(unit)) + tail, time.process_time()
        secrets.scan(text + "\nsecret = 1\n")
        return time.process_time() - start

    assert seconds(1_000_000) < 5
    if unit == "a":
        assert min(seconds(1_000_000) for _ in range(3)) < 1


def stated(text):
    """Base spans by the rule as it is stated, one pattern a kind."""
    found = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_whole_result_equals_the_rule(spark):
    docs = catalogue.documents(spark, "/root/testdata/sf0.001")
    extra = spark.createDataFrame([(-1, "x" * 30_000 + " token=" + "f" * 40), (-2, None), (-3, ""), (-3, ""), (None, "é AKIA" + "A" * 30)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).withColumns({"spans": F.lit(1), "n_hex": F.lit("x"), "kind": F.lit(2)})
    want = []
    for r in rows.collect():
        spans = stated(r.text or "")
        kinds = [k for _, _, _, k in spans]
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        want.append((str(r.doc_id), kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest))
    got = secrets.scan_documents(rows).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    by_id = {str(r.doc_id): r.text or "" for r in rows.collect()}
    for r in got:  # all spans: base ones stay, added ones are literals within the text
        base = {f"{k}:{a}:{b}" for a, _, b, k in stated(by_id[str(r.doc_id)])}
        spans = r.spans.split(",") if r.spans else []
        assert base <= set(spans) and all(s.startswith("literal:") for s in set(spans) - base)


def test_sensitive_parts_cover_every_sensitive_name():
    for word in [*secrets.SENSITIVE, *("_".join(p) for p in secrets.PAIRS)]:
        assert secrets.name_score(word) > 0 and any(part in word for part in secrets.SENSITIVE_PARTS)
    assert [t for t, _ in lexer.assignments("a = 1\nb: 2")] == ["a", "b"]
