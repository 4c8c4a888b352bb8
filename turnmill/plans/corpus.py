"""An invented corpus of sensitive and harmless texts, in the shape and number that scanners are scored on.

A case is an input with what is sensitive in it (type and value) and what must survive. Cases with nothing sensitive are guards.
"""

from __future__ import annotations

from turnmill.operators.scoring import CASE

A, B = "q7Zt2Lw9Xe4Rk8Vb1Nc6Ym3Hs5Jd0Pf", "T4gB8yU2iK6oP0aS5dF9hJ3lZ7xC1vN"
HEX = "9f86d081884c7d659a2feaa0c55ad015"

#: id, input, [(type, value)], [guards]
CASES = [
    # entropy of tokens
    ("entropy-1", f"use the token {A} here", [("secret/entropy", A)], []),
    ("entropy-2", f"KEY={B}", [("secret/entropy", B)], []),
    ("entropy-3", f"blob {A}+{B[:6]}== end", [("secret/entropy", f"{A}+{B[:6]}==")], []),
    ("entropy-4", f"session {A[:16]}.{B[:14]}/x9 was kept", [("secret/entropy", f"{A[:16]}.{B[:14]}/x9")], []),
    ("entropy-5", f'"cookie": "{B[:30]}"', [("secret/entropy", B[:30])], []),
    ("entropy-6", f"curl -H 'x: {A[2:]}{B[:4]}'", [("secret/entropy", f"{A[2:]}{B[:4]}")], []),
    ("entropy-7", f"two: {A} {B}", [("secret/entropy", A), ("secret/entropy", B)], []),
    ("entropy-8", f"AccountKey={A}{B}== in the file", [("secret/entropy", f"{A}{B}")], []),
    ("entropy-9", f"password: {A[:20]}", [("secret/entropy", A[:20])], []),
    ("entropy-10", f"api_key = '{B[:24]}'", [("secret/entropy", B[:24])], []),
    # structured personal data
    ("pii-1", "write to ann.lee+x@mail.site.example today", [("email", "ann.lee+x@mail.site.example")], []),
    ("pii-2", "call 415-555-0132 now", [("phone", "415-555-0132")], []),
    ("pii-3", "call +44 20 7946 0958 from abroad", [("phone", "+44 20 7946 0958")], []),
    ("pii-4", "(415) 555-0199 is the office", [("phone", "415) 555-0199")], []),
    ("pii-5", "the number is 123-45-6789", [("ssn", "123-45-6789")], []),
    ("pii-6", "card 4111 1111 1111 1111 expired", [("credit_card", "4111 1111 1111 1111")], []),
    ("pii-7", "card 5500-0000-0000-0004", [("credit_card", "5500-0000-0000-0004")], []),
    ("pii-8", "from 8.8.4.4 at night", [("ip", "8.8.4.4")], []),
    ("pii-9", "from 2001:db8::8a2e:370:7334 at night", [("ip", "2001:db8::8a2e:370:7334")], []),
    ("pii-10", "he lives at 12 Grove Hill Road", [("address", "12 Grove Hill Road")], []),
    ("pii-11", "send it to CA 94110-1234", [("location", "CA 94110-1234")], []),
    ("pii-12", "bob@x.io and 078-05-1120", [("email", "bob@x.io"), ("ssn", "078-05-1120")], []),
    # paths and addresses of pages
    ("path-1", "open /Users/annlee/notes/todo.txt", [("path", "/Users/annlee/notes/todo.txt")], []),
    ("path-2", "open /home/bob/.ssh/id_rsa", [("path", "/home/bob/.ssh/id_rsa")], []),
    ("path-3", "open C:\\Users\\Ann\\Desktop\\a.txt", [("path", "C:\\Users\\Ann\\Desktop\\a.txt")], []),
    ("path-4", "in /root/work there", [("path", "/root/work")], []),
    ("path-5", "log at /Users/x.y", [("path", "/Users/x.y")], []),
    ("url-1", "see https://site.example/p?user=ann#x", [("url", "/p?user=ann")], []),
    ("url-2", "see http://user:pw@host.example/x", [("url", "user:pw@")], []),
    ("url-3", "see ftp://files.spam.top/a", [("url", "files.spam.top/a")], []),
    ("url-4", "db postgres://u:secretpw@db.example/x", [("secret/connection", "secretpw")], []),
    # disguised by Unicode
    ("unicode-1", "write to ann\u200b.lee@site.example", [("email", "lee@site.example")], []),
    ("unicode-2", "call \uff14\uff11\uff15-\uff15\uff15\uff15-\uff10\uff11\uff13\uff12", [("phone", "\uff14\uff11\uff15-\uff15\uff15\uff15-\uff10\uff11\uff13\uff12")], []),
    ("unicode-3", f"key ghp_\u2060{'a1B2' * 9}", [("secret/vendor", "a1B2" * 9)], []),
    ("unicode-4", "the number is 123\u2063-45-6789", [("ssn", "-45-6789")], []),
    # identifiers that must stay
    ("guard-1", f"commit {HEX}{HEX[:8]} broke it", [], [f"{HEX}{HEX[:8]}"]),
    ("guard-2", "call computeWeightedAverageOfAllSamples() first", [], ["computeWeightedAverageOfAllSamples"]),
    ("guard-3", "the constant MAX_NUMBER_OF_CONCURRENT_REQUESTS", [], ["MAX_NUMBER_OF_CONCURRENT_REQUESTS"]),
    ("guard-4", "import org.example.project.module.SomeLongClassName", [], ["org.example.project.module.SomeLongClassName"]),
    ("guard-5", "file test_that_the_parser_reads_empty_lines.py", [], ["test_that_the_parser_reads_empty_lines.py"]),
    ("guard-6", "class=btn-primary-large-rounded-full", [], ["btn-primary-large-rounded-full"]),
    ("code-1", "std::vector<int> and dead::beef", [], ["std::vector"]),
    ("code-2", "version 1.2.3 of 2024-01-02", [], ["1.2.3", "2024-01-02"]),
    ("code-3", "at 12:30:45 it was done", [], ["12:30:45"]),
    ("code-4", "x = a[1:2] + b[::2]", [], ["a[1:2]", "b[::2]"]),
    ("code-5", "the total is 1234567 of 89", [], ["1234567"]),
    ("code-6", "decorate with @property and @staticmethod", [], ["@property", "@staticmethod"]),
    # names and places, which need a model
    ("name-1", "ask Tilda about it", [("name", "Tilda")], []),
    ("name-2", "Bram Pellard wrote this", [("name", "Bram Pellard")], []),
    ("name-3", "thanks, Ines", [("name", "Ines")], []),
    ("name-4", "Mr Orlo said so", [("name", "Orlo")], []),
    ("name-5", "Tilda and Bram met", [("name", "Tilda"), ("name", "Bram")], []),
    ("name-6", "written in Python by Ines", [("name", "Ines")], ["Python"]),
    ("name-7", "run it with Docker", [], ["Docker"]),
    ("name-8", "the Java class", [], ["Java"]),
    ("place-1", "she moved to Lorvenna", [("location", "Lorvenna")], []),
    ("place-2", "the office in Bexhollow", [("location", "Bexhollow")], []),
    ("place-3", "from Tarnmoor to here", [("location", "Tarnmoor")], []),
]


def rows() -> list[tuple]:
    return [(i, text, [(k, v, text.index(v), text.index(v) + len(v)) for k, v in spans], list(guard)) for i, text, spans, guard in CASES]


def frame(spark):
    return spark.createDataFrame(rows(), CASE)


def values() -> str:
    """(id, input, type, value, guard) for SQL, a row for each value and each guard."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    out = []
    for i, text, spans, guards in CASES:
        out += [f"({q(i)}, {q(text)}, {q(k)}, {q(v)}, NULL, {bool(spans)})" for k, v in spans] + [f"({q(i)}, {q(text)}, NULL, NULL, {q(g)}, {bool(spans)})" for g in guards]
    return ", ".join(out)
