import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haggle.llm.token_files import ByteTokenizer, ids_crc32, lookup, read_token_files, tokenizer, write_token_files
from haggle.llm.urls import host_of, judge_urls, path_of, rule_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


# -- token files

def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé \t\n\x0b\u00a0\u2003\x1c漢🙂1.<|>", max_size=25), min_size=1, max_size=4))
def test_ids_equal_library(texts):
    assert ids_of(tokenizer(PATH), texts) == [library_ids(t) for t in texts]


def ids_of(own, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in own.ids(texts)]


_LIBRARY = library()


def library_ids(t):
    return _LIBRARY.encode(t, add_special_tokens=False).ids


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr("haggle.llm.token_files.STORE", 3)
    own = ByteTokenizer(PATH)
    texts = ["one two three four five", "x" * 300 + " " + "y" * 300, "one two", "<|endoftext|> a", "don't stop"]
    for _ in range(3):
        assert ids_of(own, texts) == [library_ids(t) for t in texts]
    assert own.by_word and all(len(w) <= 64 for w in [*own.first, *own.rest, *own.pieces])


def test_frequent_words_outlive_the_store(monkeypatch):
    merged, piece = [], ByteTokenizer._piece
    monkeypatch.setattr("haggle.llm.token_files.STORE", 40)
    monkeypatch.setattr(ByteTokenizer, "_piece", lambda self, x: merged.append(x) or piece(self, x))
    own = ByteTokenizer(PATH)
    for i in range(30):
        new = "".join(chr(97 + int(d)) for d in f"{i:02d}")
        texts = [f"x the end, {' '.join(new + c for c in 'abcdefghij')} the end&&& the"]
        assert ids_of(own, texts) == [library_ids(t) for t in texts]
    assert merged.count("\u0120the") == merged.count("\u0120end") == 1
    assert sum(len(s) + len(s.old) for s in (own.first, own.rest, own.pieces, own.parts)) < 150


def test_every_common_character_is_cut_as_the_library_does():
    marks = [chr(c) for c in range(0x260)]
    texts = [f"{c}a{d}{c}1{c}!{c} {c}b{c}{c} {d}'s{c}\n{c}'ll 'T{c}'re\t{d}" for c in marks for d in ("", "é", "\x85", "²")]
    assert ids_of(ByteTokenizer(PATH), texts) == [library_ids(t) for t in texts]


def test_many_lines_without_a_space():
    texts = ["line\n" * 3000 + "end", "a " + "one,\nTwo\n" * 2000 + "x"]
    assert ids_of(ByteTokenizer(PATH), texts) == [library_ids(t) for t in texts]


def test_files(spark, awkward, small_docs, empty, tmp_path):
    path = str(tmp_path / "a")
    write_token_files(awkward.repartition(7), PATH, path)
    got = read_token_files(spark, path).select("*", ids_crc32("ids").alias("crc")).collect()
    assert len(got) == len(small_docs)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at, texts = 0, {}
    for i, t, *_ in small_docs:
        texts.setdefault(i, []).append(library_ids(t or "") + [2])
    for r in got:
        assert r.ids in texts[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    found = lookup(spark, path, [100, 105, 9999])
    assert sorted(r.doc_id for r in found.collect()) == [100, 100, 105]
    assert "In(doc_id" in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [", "")
    none = str(tmp_path / "b")
    write_token_files(empty, PATH, none)
    assert read_token_files(spark, none).collect() == []


def test_files_have_index_and_bloom_filter(spark, tmp_path):
    import pyarrow.orc as orc
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    path = str(tmp_path / "c")
    write_token_files(docs, PATH, path)
    files = [f for f in sorted((tmp_path / "c").iterdir()) if f.suffix == ".orc"]
    assert sum(orc.ORCFile(str(f)).nrows for f in files) == 5000
    assert all(b"ORC" in f.read_bytes()[:3] for f in files)
    assert spark.read.orc(path).schema["ids"].dataType.simpleString() == "array<int>"


# -- urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
         ("block", "a.b/x"), ("allow", "A.B/xy"), ("block", "tie.net/en/"), ("allow", "tie.net/en/"), ("odd", "net/"),
         ("block", ""), ("block", "/only/path")]
URLS = ["http://x.example.net/en/5?q#f", "https://EXAMPLE.net/EN/5", "http://example.net", "http://example.net/",
        "http://notexample.net/en/", "http://example.com/de/1", "http://sub.example.com/de", "ftp://q.org/fr/?x",
        "http://org/fr/", "no scheme/net/", None, "", "://net/", "http:///net/", "http://a.b/xyz", "http://a.b/xz",
        "http://c.a.b/xy/://d.net/", "http://tie.net/en/1", "http://x?y://z.net/", "http://é.net/ü#://", "http://net",
        "http://user@h.net:80/p", "http://a..net/", "x://net/" + "p/" * 3000, "http://" + "s." * 2000 + "net/en/", "http://h.net\n/x"]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, rule in rules:
        if verdict not in ("block", "allow") or not rule or rule[0] == "/":
            continue
        h, p = rule.split("/", 1)[0].translate({c: c + 32 for c in range(65, 91)}), rule[rule.index("/"):]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), h.count("."), verdict == "block", rule)
            best = max(best, (rank, rule, verdict)) if best else (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else default


def test_urls(spark):
    rows = [(i, u, "extra", "row", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "extra", "row", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, id string, digest int")
    for conf in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        got = judge_urls(pages, rule_table(spark, RULES))
        assert got.columns == ["page_id", "url", "id", "digest", "host", "path", "rule", "verdict"]
        out = got.collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, RULES), r.url
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    r = judge_urls(pages, rule_table(spark, []), default="block").first()
    assert (r.host, r.path, r.rule, r.verdict) == ("x.net", "/", None, "block")
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).collect() == []


def test_url_parts(spark):
    pages = spark.createDataFrame([(u,) for u in URLS], "url string")
    for r in pages.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect():
        assert (r.h, r.p) == brute(r.url, [])[:2]
