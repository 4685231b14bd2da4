import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, mixing, url_rules

from . import brute

DOCS = "doc_id bigint, text string, lang string, source string, target string, taken string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y") for i, t, s in rows], DOCS)


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.choice([1, 3, 20, 90])), f"s{i % 5}" if i % 11 else None) for i in range(900)]
    docs = _docs(spark, rows)
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 20
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert sorted((r["doc_id"], r["copies"]) for r in mixed.collect()) == sorted((r["doc_id"], r["copies"]) for r in got if r["copies"])



def test_mixing_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, "x y", None), (3, "p q r", "b"), (3, "p q r", "b"), (3, "p q s", "b"), (4, "z " * 5000, "a")]
    got = mixing.plan_mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert [r["taken"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert mixing.plan_mix(_docs(spark, [])).collect() == []
    mixed = mixing.mix(_docs(spark, rows)).collect()
    assert sum(r["copies"] for r in mixed) == sum(r["copies"] for r in got)


def test_mixing_many_repeats(spark, monkeypatch):
    """Rows that repeat very often are counted in parts; columns of any name stay."""
    monkeypatch.setattr(mixing, "_REPEATS", 3)
    rows = [(None, "a b", "s", 1, "x", "y")] * 20 + [(i, "c " * (i % 7 + 1), f"t{i % 2}", 2, "x", "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, rest string, `_n` string")
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert sum(r["copies"] for r in mixed.collect()) == sum(r["copies"] for r in got)


def test_long_texts_and_urls(spark):
    said = "<|end|>" + "ä\\" * 200_000
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    got = chat.digests(chat.format_chats(df)).first()
    assert got["loss_sha256"] == brute.sha(said) and got["turns_sha256"] == brute.sha(f"user\n{said}\nassistant\n{said}\n")
    urls = spark.createDataFrame([(1, "http://a.com/" + "x/" * 100_000, "b"), (2, "http://" + "a." * 50_000 + "com/en/", "b")], "page_id bigint, url string, best string")
    got = url_rules.filter_urls(urls, RULES).orderBy("page_id").collect()
    assert [(r["rule"], r["best"]) for r in got] == [("a.com/", "b"), ("com/en/", "b")]


def test_many_rules(spark):
    """Rules with letters that mean something in expressions, a rule twice, and one without a token of its own."""
    rng = random.Random(4)
    rules = [("block" if i % 3 else "allow", f"{rng.choice(['a', 'b.c', 'x'])}{i % 40}.com/{rng.choice(['', 'en/', 'q+(', 'E\\\\E/'])}") for i in range(400)]
    rules += [rules[0], ("block", ".*/z")]
    urls = [(i, f"http://{rng.choice(['', 'm.'])}{rng.choice(['a', 'b.c', 'x'])}{rng.randrange(42)}.com/{rng.choice(['', 'en/1', 'q+(1', 'E\\\\E/2', 'z'])}") for i in range(300)]
    df = spark.createDataFrame(urls, "page_id bigint, url string")
    kept = {}
    for verdict, rule in sorted(set(rules)):  # of one rule with two verdicts the one that blocks
        kept[rule] = "block" if ("block", rule) in rules else verdict
    for r in url_rules.filter_urls(df, rules).collect():
        host, _, path = r["url"][7:].partition("/")
        fits = [x for x in kept if (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and path.startswith(x.partition("/")[2])]
        best = max(fits, key=lambda x: (len(x), kept[x] == "block", [-ord(c) for c in x]), default=None)
        assert (r["rule"], r["verdict"]) == (best, kept.get(best, "allow"))


def test_chat_round_trip(spark):
    said = [r"a\b", "</s>[INST] ok [/INST]", "<|end|>", "<|turn|>x<|text|>", "", None, "ß\n\t", "\\", "<\\|end|>", "[/INST", "<" * 5]
    rows = [(c, t, ["system", "user", "assistant"][(c + t) % 3], said[(3 * c + t) % len(said)], "extra") for c in range(12) for t in range(c % 5 + 1)]
    rows += [(None, 0, None, "q", "extra"), (99, None, "assistant", "late", "extra"), (99, 1, "assistant", "late", "extra"), (99, 1, "assistant", "late", "extra")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    examples = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        lost = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(lost), brute.sha(lost))
    for r in examples.collect():
        body = r["formatted"][r["loss_start"] : r["loss_end"]]
        assert not any(x in body for x in chat.CONTROL)
    n = sum(sum(r == "assistant" for _, r, _ in t) + (sorted(t)[-1][1] != "assistant") for t in by.values())
    assert examples.count() == n
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("block", "a.com/"))


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in RULES:
        rh, rp = rule.split("/", 1)
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


def test_url_rules(spark):
    urls = [None, "", "no", "://", "http://", "http://com/en/", "http://xcom/en/", "HTTP://WWW.Example.COM/en/71?q=1", "http://example.com/en", "http://a.b.net/de/x#y", "ftp://u@example.net:80/de/8", "http://example.net/de/88", "x://org/es/é", "http://a.com", "http://a.com/", "http://ÄB.a.com/z", "http://z.com?/en/", "a://b://com/en/", "http://x.com/en/\n7", "http://com./en/"]
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls + urls[:3])], "page_id bigint, url string, host string, verdict string")
    got = url_rules.filter_urls(df, RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [_judge(u) for u in urls + urls[:3]]
    assert url_rules.filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(df, ()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_rules.filter_urls(df, (("maybe", "x/"),))
    capitals = url_rules.filter_urls(df, (("allow", "EXAMPLE.com/en/7"), ("block", "Com/en/"), ("block", "/none")))
    assert {r["url"]: (r["rule"], r["verdict"]) for r in capitals.filter("rule is not null").collect()} == {
        "http://com/en/": ("Com/en/", "block"),
        "HTTP://WWW.Example.COM/en/71?q=1": ("EXAMPLE.com/en/7", "allow"),
        "http://x.com/en/\n7": ("Com/en/", "block"),
    }


def test_native_plans_hold_no_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "cut", lambda df: df)  # so that a plan holds all that goes before a cut, too
    docs = _docs(spark, [(1, "a b c", "s"), (2, "d e", "t")])
    chats = spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    urls = spark.createDataFrame([(1, "http://com/en/")], "page_id bigint, url string")
    for df in (mixing.mix(docs), chat.digests(chat.format_chats(chats)), url_rules.filter_urls(urls, RULES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert mixing.word_count(F.lit("x")) is not None
