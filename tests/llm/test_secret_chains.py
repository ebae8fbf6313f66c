"""Chains of literals and names, and white space around operators, in the secret lexer."""

import time

import pytest

from cairngraph.llm import secrets


@pytest.mark.parametrize(
    "text,want",
    [
        ('secret = prefix + "s3cr3tLongLiteral99"', ["s3cr3tLongLiteral99"]),
        ('secret = prefix+"s3cr3tLongLiteral99"', ["s3cr3tLongLiteral99"]),
        ('password = "abcd" + "Efgh1234xyz"', ["abcd", "Efgh1234xyz"]),
        ('password = "Ab1" + "cD2" + \'eF3#\'', ["Ab1", "cD2", "eF3#"]),
        ('head = "Ab1x"\npassword = head + "cD2" + "eF3#"', ["Ab1x", "cD2", "eF3#"]),
        ('password = head + "cD2" + "eF3#"\nhead = "Ab1x"', ["cD2", "eF3#", "Ab1x"]),
        ('a = "Ab1x" + "cD2"\nb = a + "eF3#"\npassword = b', ["Ab1x", "cD2", "eF3#"]),
        ('password = "s3cr3tLongLiteral99" + " and words"', ["s3cr3tLongLiteral99"]),
        ('password\t=\t"s3cr3tLongLiteral99"', ["s3cr3tLongLiteral99"]),
        ('client_secret:\ts3cr3tLongLiteral99', ["s3cr3tLongLiteral99"]),
        ('password = "ab"\t+\t"cdEfgh1234xyz"', ["ab", "cdEfgh1234xyz"]),
        ('colour = "abcd" + "Efgh1234xyz"', []),
        ('password = password + x\nx = x + password', []),
    ],
)
def test_chains_are_built_and_scored(text, want):
    _, added = secrets.scan(text)
    assert [text[a:b] for _, a, b in added] == want


def test_long_and_doubling_chains_end():
    lines = ['v0 = "Ab1x"'] + [f"v{i + 1} = v{i} + v{i}" for i in range(3000)] + ["password = v3000 + 'cD2#'"]
    text, start = "\n".join(lines), time.time()
    _, added = secrets.scan(text)
    back = "\n".join(lines[::-1])
    assert [text[a:b] for _, a, b in added] == ["Ab1x", "cD2#"]
    secrets.scan(back)
    assert time.time() - start < 5
