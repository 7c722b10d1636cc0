"""Many terms and many URLs against the plain way."""

import random
import re
import time

from pyspark.sql import functions as F

from inkstrata.functions import cleanup
from inkstrata.functions import protect as P

RNG = random.Random(4)
SF = "/root/testdata/sf0.001"


def plain_pattern(terms):
    return "(?sU)" + "|".join(f"(?:{P.term_pattern(t)})" for t in sorted(set(terms), key=len, reverse=True))


def test_terms_match_as_their_own_patterns_do(values):
    terms = ["a", "ab", "abc", "ab c", "b+", "+b", "ü", "üb", "$x", "x_1", "_x", "a b", "日本", "日本語", "\\E", "Q\\", "a-", "-a"]
    texts = ["".join(RNG.choices(["a", "b", "c", " ", "+", "ü", "$", "x", "_1", "日本", "語", "\\E", "Q\\", "-"], k=RNG.randint(0, 25))) for _ in range(300)]
    got = values(lambda c: F.regexp_extract_all(c, F.lit("(?sU)" + P.terms_pattern(terms)), F.lit(0)), *texts)
    assert got == values(lambda c: F.regexp_extract_all(c, F.lit(plain_pattern(terms)), F.lit(0)), *texts) and sum(map(len, got)) > 500
    assert values(lambda c: P.spans(c, ()), "a b") == values(lambda c: P.spans(c, ("",)), "a b") == [[]]
    assert P.terms_pattern(()) == "(?!)"
    # Longest first among terms that hold one another, and what may move.
    held = values(lambda c: P.protect(c, ("token", "token list", "list")), "a token list, token; list $x$ <b>")[0]["replacements"]
    assert [(r["value"], r["ordered"]) for r in held] == [("token list", False), ("token", False), ("list", False), ("$x$", False), ("<b>", True)]


def test_fifty_thousand_terms_cost_what_fifty_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    words = sorted({w for r in docs.limit(60).collect() for w in re.findall(r"\w+", r["text"])})
    many = [*words[:20_000], *(f"{RNG.choice(words)} {RNG.choice(words)}" for _ in range(20_000)), *(f"{RNG.choice(words)}{k}" for k in range(30_000))][:50_000]
    took = {}
    for n, terms in ((50, many[:50]), (50_000, many)):
        P.spans(F.col("text"), terms)
        rows = docs.select(F.sum(F.size(P.spans(F.col("text"), terms))))
        began = time.time()
        rows.collect()
        took[n] = time.time() - began
    assert took[50_000] < 10 * took[50] + 10
    few = RNG.sample(many, 150)
    sample = docs.limit(40)
    own = [r[0] for r in sample.select(P.spans(F.col("text"), few)).collect()]
    plain = "(?sU)" + "|".join(f"(?:{p})" for p in [*P.SPANS, plain_pattern(few).removeprefix("(?sU)")])
    assert own == [r[0] for r in sample.select(F.regexp_extract_all("text", F.lit(plain), F.lit(0))).collect()]


def slow_ends(source, translated):
    known = set(re.findall(r"https?://[a-z./0-9]+", source))

    def apart(m):
        fits = [u for u in known if m[0].startswith(u)]
        best = max(fits, key=len, default=m[0])
        return f"{best} {m[0][len(best):]}" if re.match(r"[A-Za-z0-9_]", m[0][len(best) :]) else m[0]

    return re.sub(r"https?://[a-z./0-9]+", apart, translated)


def test_longest_urls_of_very_many(values):
    hosts = ["".join(RNG.choices("abc", k=RNG.randint(1, 6))) for _ in range(60)]
    some = [f"https://{h}.org/{'/'.join(RNG.choices('abc', k=RNG.randint(0, 4)))}" for h in hosts for _ in range(3)]
    pairs = [(" ".join(RNG.sample(some, RNG.randint(0, 60))), " ".join(u + RNG.choice(["", "the", ".", "a/b", "1"]) for u in RNG.sample(some, 50))) for _ in range(8)]
    assert values(cleanup.with_url_ends, *pairs) == [slow_ends(*p) for p in pairs]
    source = " ".join(f"https://e.org/{k}/x" for k in range(10_000))
    began = time.time()
    got = values(cleanup.with_url_ends, (source, source.replace("/x", "/xthe")))[0]
    assert time.time() - began < 60 and got == source.replace("/x", "/x the")


def test_code_marks_around_terms(values):
    def run(s, t):
        return cleanup.without_code_terms(s, t, ["tok$en", "tok", "a b", "`odd"])

    assert values(run, ("tok", "`tok` ``tok$en`` `a b` `other`"), ("`tok` x", "`tok` `a b`"), ("", ""), (None, "`tok`")) == ["tok tok$en a b `other`", "`tok` a b", "", "tok"]
