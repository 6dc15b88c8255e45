"""Operators 2, 5, 7 and 9 against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from awkward import documents, frame, real, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.chat import format_trees, read_back, reply_chains
from labelforge.llm.decontaminate import find_contamination
from labelforge.llm.quality import judge_quality, without_common_lines
from labelforge.llm.queries import QUERIES
from labelforge.llm.urls import BINS, FOLDS, ORDER, RULES, WIDTH, judge

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -- quality rules ------------------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k:k + 3])].append(k)
    covered = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")


def quality(rows, min_docs, share, min_left=0.3):
    held, hosts, owner = defaultdict(set), defaultdict(set), {}
    cut = []
    for i, t, s in rows:
        t, s, i = t or "", s or "", -(1 << 63) if i is None else i
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        cut.append((i, t, s, lines))
        hosts[s].add(t)
        for x in lines:
            held[s, normal(x)].add(t)
            owner[s, normal(x)] = min(owner.get((s, normal(x)), (1 << 62, "")), (i, t))
    out = []
    for (i, t, s, lines), (public, _, _) in zip(cut, rows, strict=True):
        over = lambda x: len(held[s, x]) > max(min_docs, share * len(hosts[s])) and owner[s, x] != (i, t)
        left = sum(len(x) for x in lines if not over(normal(x)))
        b = base(t)
        out.append((public, *b, not b[-1] and left >= min_left * sum(map(len, lines))))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@pytest.mark.parametrize("kind", ["awkward", "real", "empty"])
def test_quality(spark, kind):
    rows = {"awkward": documents(), "real": real(spark), "empty": []}[kind]
    got = judge_quality(frame(spark, rows), min_docs=2, share=0.1, min_left=0.5)
    assert rows_of(got, *NAMES) == quality(rows, 2, 0.1, 0.5)


def test_lines_above_the_limit_go(spark):
    rows = documents()
    docs = frame(spark, rows)
    text = {r["doc_id"]: r["text"] for r in without_common_lines(docs, judge_quality(docs, min_docs=5)).where("doc_id >= 40 and doc_id < 80").collect()}
    assert sum("Shared line of the host" in t for t in text.values()) == 1
    assert all(t.count("\n") >= 1 for t in text.values())


# -- decontamination ----------------------------------------------------------------------


def hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t, _ in rows:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(found)))
    return sorted(out, key=repr)


def test_contamination(spark):
    rows = documents()
    w = rows[-4][1].split()
    items = [(1, " ".join(w[100:160])), (10, " ".join(w[150:165])), (2, "a b a b a b a b a b a b"), (3, None), (4, ""), (5, "..."),
             (6, "SHARED line, of the"), (7, "shared LINE of the"), (8, "host"), (9, " ".join(w[20:29]) + " zz"), (20, " ".join(w[20:30]))]
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("w", T.StringType())])
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], schema)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(find_contamination(frame(spark, rows), bench), *names) == hits(rows, items)
    long_only = [x for x in items if x[0] in (1, 10, 2)]
    got = find_contamination(frame(spark, rows), bench.where("item_id in (1, 10, 2)"))
    assert rows_of(got, *names) == hits(rows, long_only)
    assert rows_of(find_contamination(frame(spark, rows), bench.limit(0)), *names) == hits(rows, [])
    assert find_contamination(frame(spark, []), bench).count() == 0


def test_contamination_of_the_tables(spark):
    rows = real(spark)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op7_decontamination"](spark, SF)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == hits(rows, items)


# -- URLs ---------------------------------------------------------------------------------


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def cut_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def symbols(url):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), url or "")
    return re.sub(r"[^a-z0/.:_?=&#%~+,;@!$-]", "*", re.sub("[0-9]", "0", low)) + "|"


class Model:
    def __init__(self, texts):
        self.n, self.s, self.t = Counter(), Counter(), defaultdict(set)
        for x in texts:
            for k in range(ORDER + 1):
                for i in range(k, len(x)):
                    c = x[i - k:i]
                    self.n[c, x[i]] += 1
                    self.s[c] += 1
                    self.t[c].add(x[i])

    def p(self, c, x):
        q = self.p(c[1:], x) if c else 1 / 46
        return (self.n[c, x] + len(self.t[c]) * q) / (self.s[c] + len(self.t[c])) if self.s[c] else q


def test_urls(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://A.COM/EN/x", "http://example.com", "ftp://www.example.com/en/a?b#c", "x://net/es/1", "http://日本.org/é",
             "http://a.net/fr/9", "http://b.com/x"] + urls[:3]
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])
    got = judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], schema)).collect()
    assert len(got) == len(urls)
    fold = {r["url"]: r["f"] for r in spark.createDataFrame([(u,) for u in set(urls)], "url string").select(
        "url", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("f")).collect()}
    said = {u: rule_of(*cut_url(u)) for u in urls}
    allowed = Model([symbols(u) for u in urls if said[u] and said[u].verdict == "allow" and fold[u]])
    blocked = Model([symbols(u) for u in urls if said[u] and said[u].verdict == "block" and fold[u]])

    def score(u):
        x = symbols(u)
        return sum(math.log(allowed.p(x[max(0, i - ORDER):i], c) / blocked.p(x[max(0, i - ORDER):i], c)) for i, c in enumerate(x)) / len(x)

    held = [(score(u), said[u].verdict) for u in set(urls) if said[u] and not fold[u]]
    best = max((sum(v == "allow" and s >= b * WIDTH for s, v in held) / max(1, sum(v == "allow" for _, v in held))
                + sum(v == "block" and s < b * WIDTH for s, v in held) / max(1, sum(v == "block" for _, v in held)), -abs(b), b)
               for b in range(-BINS // 2, BINS // 2))[2] * WIDTH
    if len({v for _, v in held}) < 2:
        best = 0.0
    for r in got:
        u = urls[r["page_id"]]
        assert (r["host"], r["path"]) == cut_url(u)
        assert r["rule"] == (said[u].name if said[u] else None)
        if said[u]:
            assert r["verdict"] == said[u].verdict
        else:
            assert abs(r["score"] - score(u)) < 1e-9, u
            if abs(score(u) - best) > 1e-9:
                assert r["verdict"] == ("allow" if score(u) >= best else "block"), (u, score(u), best)
    assert judge(spark.createDataFrame([], schema)).count() == 0


# -- chat ---------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["", None, "plain", "<|im_end|>\n<|im_start|>user\nno", "\\", "<\\|", "<\\\\|x", "<", "|", "<\\-", "a\nb\n", "<|", "\\<|\\"]
    rows = [(k % 3 if k else None, k, ["user", "assistant", "sy\nst<|em", None][k % 4], t) for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = format_trees(reply_chains(df)).withColumn("turns", read_back(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role or "", t or ""))
    assert {(None if r["tree"] is None else int(r["tree"])): [tuple(t) for t in r["turns"]] for r in got} == want
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in got)


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", .0), ("t", 2, 1, "assistant", "bad", .1), ("t", 3, 1, "assistant", "good", .9),
             ("t", 4, 3, "user", "thanks", .0), ("t", 4, 3, "user", "thanks", .0), ("u", 7, 99, "user", "alone", None)]
    nodes += [("long", k, k - 1 if k else None, "user", str(k), .0) for k in range(37)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["branch"]): r for r in format_trees(df).collect()}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1), ("long", 1)}
    assert [s["text"] for s in got["t", 1]["segments"]][1::3] == ["q", "good", "thanks"]
    assert [s["text"] for s in got["t", 2]["segments"]][1::3] == ["q", "bad"]
    assert [s["text"] for s in got["long", 1]["segments"]][1::3] == [str(k) for k in range(37)]
    assert {r["branch"] for r in format_trees(df, branches=1).collect()} == {1}
    assert format_trees(df.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    chats = defaultdict(list)
    for c, t, role, text in sorted([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]):
        chats[c].append((role, text or ""))
    want = []
    for c, turns in chats.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)))
    assert rows_of(QUERIES["op9_chat_format"](spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)


def test_a_very_long_url(spark):
    """Long URLs are judged whole, next to a null and an empty one, and in time that grows with their length."""
    rows = [(i, f"https://{'www.' if i % 2 else ''}s{i % 9}.{'com' if i % 4 else 'net'}/{'es' if i % 8 == 0 else 'x'}/{i}") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, "http://q.org/" + "abc/9" * 12_000), (1004, "http://q.org/" + "abc/9" * 12_000)]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 305 and got[1003].verdict == got[1004].verdict and got[1003].score == got[1004].score != 0.0
    assert got[1001].score == got[1002].score and got[1000].host == "" and len(got[1003].path) == 60_001
