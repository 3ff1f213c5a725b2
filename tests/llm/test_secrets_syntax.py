"""Operator 4: pairs of names and values in many syntaxes, recall of planted secrets, and time on hostile texts."""

import random
import string
import time

import pytest

from webdistill.llm import secrets

V = "Zx81kQ9p77LmPq2v"

FOUND = [
    f"<password>{V}</password>", f"<db-password type='x'>\n {V} \n</db-password>", f'setPassword("{V}")', f'credential: str = "{V}"', f'credential: Optional[str] = "{V}"',
    f'credential = ("{V[:8]}"\n    "{V[8:]}")', f'credential = """{V}"""', f"credential = '''{V}'''", f'credential = f"{{x}}{V}"', f'String credential = new String("{V}");',
    f'{{"client_credential": ["{V}"]}}', f'{{"client_credential": ["a", "{V}"]}}', f'{{"credentials": {{"main": {{"v": "{V}"}}}}}}', f"credentials:\n  main:\n    - x: 1\n    v: {V}\n",
    f'put("auth_credential", "{V}")', f'<property name="auth_credential" value="{V}"/>', f"- name: AUTH_CREDENTIAL\n  value: {V}\n", f'{{"name": "AUTH_CREDENTIAL", "value": "{V}"}}',
    f'credential = "{V[:8]}" \\\n    "{V[8:]}"', f'credential = "{V[:8]}" + \\\n  "{V[8:]}"', f"credential := `{V}`", f"'credential' => '{V}',", f'credential = b"{V}"', f'auth.credential = decode("{V}")',
    f'const char *credential = "{V}";', f'let credential: &str = "{V}";', f"export AUTH_CREDENTIAL={V}", f"credential = os.environ.get('x', '{V}')" if False else f"credential='{V}'",
]


@pytest.mark.parametrize("text", FOUND)
def test_syntaxes(text):
    found = "".join(text[a:b] for a, b, _ in secrets.literal_spans(text))
    assert found.replace("a" if '["a"' in text else "\0", "") == V, secrets.literal_spans(text)


@pytest.mark.parametrize("text", [
    f"<title>{V}</title>", f'print("{V}")', f'name: str = "{V}"', f'{{"items": ["{V}"]}}', f'<property name="color" value="{V}"/>', f'put("color", "{V}")', "setPassword(\"changeme-please\")",
    "<password>your password here</password>", "credential = ('a word' 'or two')", "the token: it was said (\"and it is so\")", f"credentials:\n  a: 1\nother: {V}\n", f'{{"credential": {{}}, "color": "{V}"}}',
])
def test_clean(text):
    assert secrets.literal_spans(text) == []


def test_recall_of_planted_secrets():
    """Random secrets in random syntaxes between lines of prose and code: nine in ten are marked whole, and no decoy."""
    r = random.Random(5)
    names = ["client_secret", "dbPassword", "API_KEY", "auth.token", "private-key", "aws_access_key", "smtp_passwd", "bearerToken", "DSN", "signing_credential"]
    decoys = ["title", "author", "color", "file_name", "version", "url", "comment", "digest", "uuid", "colour_scheme"]
    forms = ['{n} = "{v}"', "{n}: {v}", "{n}: '{v}'", '{{"{n}": "{v}"}}', "<{n}>{v}</{n}>", 'set_{n}("{v}")', '{n}: str = "{v}"', "export {n}={v}", "'{n}' => '{v}'", '{n} = ("{a}"\n  "{b}")', '<p name="{n}" value="{v}"/>', 'put("{n}", "{v}")']
    planted = caught = wrong = 0
    for _ in range(150):
        text, spans, clean = "", [], []
        for _ in range(r.randint(1, 6)):
            v = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(16, 48)))
            secret = r.random() < 0.6
            n, form = r.choice(names if secret else decoys), r.choice(forms)
            text += r.choice(["", "It was late, and nobody spoke.\n", "def f(x):\n    return x + 1\n\n", "for (i = 0; i < 9; i++) {\n}\n"])
            line = form.format(n=n, v=v, a=v[:9], b=v[9:])
            for piece in [v] if v in line else [v[:9], v[9:]]:
                a = len(text) + line.index(piece)
                (spans if secret else clean).append((a, a + len(piece)))
            text += line + "\n"
        marked = {(a, b) for a, b, _ in secrets.scan_text(text.encode())}
        inside = lambda x: any(a <= x[0] and x[1] <= b for a, b in marked)  # noqa: E731, B023
        planted += len(spans)
        caught += sum(map(inside, spans))
        wrong += sum(map(inside, clean))
    assert caught >= 0.9 * planted and wrong <= 0.02 * planted, (planted, caught, wrong)


HOSTILE = {
    "brackets": "a=" + "(" * 300_000, "braces": "{" * 300_000 + "}" * 300_000, "quotes": "k='''" * 80_000, "operators": "=" * 100_000 + ":" * 100_000, "calls": 'a("' * 100_000, "commas": '","' * 100_000,
    "elements": "<a " * 100_000 + "<a>" * 100_000, "indents": "".join(" " * (i % 50) + f"k{i}:\n" for i in range(40_000)), "names": "a." * 300_000 + "=x", "blanks": "a =" + " " * 300_000, "fields": 'a = f"' + "{x}" * 100_000 + '"',
    "lists": "a = [" + "'b', " * 60_000, "joins": "a = " + "'b' + " * 60_000, "lines": "a = (" + "'b'\n" * 60_000, "one line": "a: 'b', " * 60_000, "types": "a: b " * 60_000 + "= 1", "wraps": "a=f(" * 60_000 + "'x'",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_on_hostile_texts(name):
    began = time.perf_counter()
    secrets.literal_spans(HOSTILE[name])
    assert time.perf_counter() - began < 8
