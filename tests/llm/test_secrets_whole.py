"""Operator 4 without caps: long values, long literals, wide columns and values of many parts."""

import random
import string

from webdistill.llm import secrets


def key(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))


def literals(text: str) -> list[str]:
    return [text[a:b] for a, b, _ in secrets.literal_spans(text)]


def test_long_values_are_whole():
    for n in (500, 800, 5000):
        assert literals(f"client-key-data: {key(n)}\nnext: 1") == [key(n)]
        assert literals(f'private_key = "{key(n)}"\n') == [key(n)]


def test_wide_columns_and_long_names():
    assert literals(f"db_password{' ' * 40}= '{key(24)}'") == [key(24)]
    name = "settings." * 30 + "x"
    assert literals(f"{name} = '{key(24)}'\nauth_token = {name}\n") == [key(24)]


def test_all_parts_of_a_secret():
    text = "".join(f"p{i} = '{key(12, i)}'\n" for i in range(200)) + "secret_key = " + " + ".join(f"p{i}" for i in range(200)) + "\n"
    assert literals(text) == [key(12, i) for i in range(200)]
    assert literals(text + "again = secret_key\nauth_token = again\n") == [key(12, i) for i in range(200)]
    text = "token = ''\n" + "".join(f"token = token + '{key(12, i)}'\n" for i in range(900))
    assert literals(text) == [key(12, i) for i in range(900)]


def test_doubled_values():
    text = f"part = '{key(16)}'\n" + "part = part + part\n" * 3000 + "auth_token = part\n"
    assert literals(text) == [key(16)]


def test_a_long_key_is_no_placeholder_by_chance():
    value = key(3000) + "xxx" + key(3000)
    assert literals(f"auth_key: {value}\n") == [value] and literals(f"auth_key = '{value}'\n") == [value]
    assert literals(f"auth_key = '{key(30)}xxx'\n") == literals(f"auth_key = '{'<b>' + key(20) * 3:s}{'<br>' * 300}'\n") == []


def test_summaries_add_up():
    r = random.Random(4)
    pool = ["a", "B7", " ", "\t", "exam", "ple", "x", "xx", "Zx81kQ9p", "é", "change", "-me", "${", "1"]
    for _ in range(3000):
        parts = [r.choice(pool) for _ in range(r.randint(1, 9))]
        total = secrets.Summary()
        for p in parts:
            total += secrets.Summary(p)
        assert total.randomness() == secrets.randomness("".join(parts)), parts


def test_operators_inside_long_bare_values():
    r = random.Random(6)
    text = "a_token=" + "=".join(f"{r.choice(['k', 'auth', 'your'])}{key(r.randint(0, 60), i)}" for i in range(60))
    text = text.replace("aa", "xxxx")
    bare = secrets._BareRuns(text)
    for at in range(8, len(text)):
        v = bare.leaf(at)
        assert (v is None) == (len(text) - at < 6)
        if v:
            assert v.span == (at, len(text)) and abs(v.summary.randomness() - secrets.randomness(text[at:])) < 1e-9
