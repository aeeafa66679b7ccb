"""Chat formatting, URL rules and host rules against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from diurna.llm import chat, quality_rules, url_filter
from diurna.llm.queries import FORGED, URL_RULES

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", FORGED), (1, 2, "assistant", "and <|more|> &amp; more"), (1, 3, "user", None),
    (2, 5, "assistant", ""), (2, 5, "assistant", "tie"), (2, 1, None, "no role"), (2, None, "system", "first"),
    (None, 0, "user", "null conversation"), (3, 0, "us<er", "<|turn|><|end|>\n&lt;"), (4, 0, "assistant", "x\ny"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn(
        "formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest(chat.read_back(chat.format_conversations(df))).collect()}
    by = {}
    for c, t, r, x in TURNS:
        by.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    for c, rows in by.items():
        rows.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def test_adjacent_turns_are_merged(spark):
    df = spark.createDataFrame(TURNS[:4], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).first()
    assert out.formatted.count(chat.TURN) == 3 and out.formatted.count(chat.MORE) == 1
    assert [out.formatted[s.start:s.start + s.length] for s in out.loss_spans] == [
        FORGED.replace("<", "&lt;"), "and &lt;|more|> &amp;amp; more"]


URLS = ["http://A.Example.com/en/x?q", "http://www.example.com/en/1", "http://xwww.example.com/en/1", "http://a.net/es/",
        "http://net/fr/2#t", "http://b.net/de/", "http://notcom/en/", "http://com", "http://com/", None, "", "no scheme",
        "x://y://z.com/en/p", "http://example.com?x=/en/", "ftp://ÀB.example.com/EN/"]


def _brute(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.pattern) > len(best.pattern):
                best = r
    return host, path, best


def test_url_rules_and_model(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    model = url_filter.fit(url_filter.labelled_by_rules(df, URL_RULES))
    got = url_filter.judge(df, URL_RULES, model).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule = _brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        assert r.verdict == (rule.verdict if rule else ("block" if r.p_block >= 0.5 else "allow"))


def test_url_model_learns_and_falls_back(spark):
    rows = [(f"h{i}.good.com", f"/a/{i}", 0) for i in range(60)] + [(f"h{i}.bad.net", f"/b/{i}", 1) for i in range(60)]
    model = url_filter.fit(spark.createDataFrame(rows, "host string, path string, blocked int"))
    df = spark.createDataFrame([("http://z.bad.net/b/9",), ("http://z.good.com/a/9",)], "url string")
    assert [r.verdict for r in url_filter.judge(df, [], model).orderBy("url").collect()] == ["block", "allow"]
    none = spark.createDataFrame([], "host string, path string, blocked int")
    assert url_filter.fit(none) == "allow"
    assert url_filter.fit(spark.createDataFrame([("a", "/", 1)], "host string, path string, blocked int")) == "block"
    assert url_filter.judge(df.where("false"), URL_RULES, "allow").count() == 0


def _counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_rule_counts(spark):
    texts = ["", None, "a", "a b c", "a b c d", "a b c a b c", "a a a a", "x y z\nx y z\n \nx y z", " # $ %\t&|<>*\x0b",
             "é\u00a0b c é\u00a0b c é\u00a0b c", "a b a b a b a b", "w " * 3000, "one two three " * 40 + "end"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.text_counts(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == _counts(t or ""), t


def test_host_verdicts(spark):
    # a bad host, a good one, a host with one failing document that the prior shrinks, a null host
    rows = [("bad", 10, 0)] * 40 + [("good", 100, 0)] * 40 + [("tiny", 10, 0)] + [(None, 100, 0)] * 3 + [("good", 100, 60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, n_words long, n_repeat_words long")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows)
    v = {r.host: r.shrunk_rate for r in got}
    rates = [1.0, 1 / 41, 1.0, 0.0]
    m = sum(rates) / 4
    w = max(1.0, m * (1 - m) / (sum((x - m) ** 2 for x in rates) / 4) - 1)
    assert v["tiny"] == pytest.approx((1 + w * m) / (1 + w)) and v["good"] == pytest.approx((1 + w * m) / (41 + w))
    assert not any(r.kept for r in got if r.host == "bad")
    assert sum(r.kept for r in got if r.host == "good") == 40 and all(r.kept for r in got if r.host is None)
    assert quality_rules.judge(df.where("false")).count() == 0


def test_a_long_conversation_takes_linear_time(spark):
    """100,000 turns: every text under the mask once and in order, whatever blocks they merge into."""
    n = 100_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role",
                                   "concat('t\u00e9<', id, IF(id % 7 = 0, '</s>&lt;', '')) AS text")
    r = chat.digest(chat.read_back(chat.format_conversations(df.repartition(4)))).first()
    texts = [f"t\u00e9<{i}" + ("</s>&lt;" if i % 7 == 0 else "") for i in range(n)]
    learn = "".join(t for i, t in enumerate(texts) if i % 3)
    turns = "".join(f"{'assistant' if i % 3 else 'user'}\n{t}\n" for i, t in enumerate(texts))
    assert (r.n_turns, r.loss_chars) == (n, len(learn))
    assert r.loss_sha256 == hashlib.sha256(learn.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
