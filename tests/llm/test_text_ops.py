"""Operators over documents, against brute-force versions, and their edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.llm import chat, decontaminate, htmltext, licenses, minhash, mixing, quality, tokencount, toxicity, vectors
from voxelspark.llm import textblocks as tb

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: (t or "").translate(LOW)
alnum = lambda t: ALNUM.findall(low(t))
spaced = lambda t: SPACED.findall(low(t))

rnd = random.Random(11)
VOCAB = [f"w{k}" for k in range(300)] + ["é", "ÜBER", "the", "of"]


def prose(n, r=rnd):
    return " ".join(r.choice(VOCAB) for _ in range(n))


ODD = ["", None, "   ", "one", "two words", "Three short words", "a\tb\nc  d e", "\x00\x01 \x0b x", "é" * 50, "x" * 5000, "ß ẞ İ ı Σς", "." * 300]


def corpus():
    """Odd texts, exact and near copies, shared passages, one very long text."""
    texts = list(ODD)
    base = [prose(rnd.randint(30, 120)) for _ in range(20)]
    texts += base + base[:5] * 3
    for b in base[:10]:
        for cut in (1, 3, 8):
            w = b.split()
            for _ in range(cut):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            texts.append(" ".join(w).upper() if cut == 1 else " ".join(w))
    passage = prose(40)
    texts += [f"{prose(10)} {passage} {prose(60)}" for _ in range(10)]
    texts.append(prose(30000))
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


DOCS = corpus()
SCHEMA = "doc_id long, text string"


def docs_frame(spark, rows=None):
    """With columns whose names operators use inside."""
    rows = DOCS if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: F.lit(c) for c in ("rep", "comp", "n", "size", "key", "u", "v", "score", "label", "taken", "words", "target")}
    return df.withColumns(extra | {"source": F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)), "lang": F.lit(None).cast("string")})


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# --- words


def test_words_are_what_the_patterns_give():
    texts = [t for _, t in DOCS]
    import pyarrow as pa

    for limit in (1 << 20, 64):
        for i, j, raw, offs in tb.slices(pa.array(texts), limit):
            for table, words in ((tb.SPACED, spaced), (tb.ALNUM, alnum)):
                b = tb.Block(raw, offs, table)
                for r in range(i, j):
                    got = [b.word(x).decode() for x in range(b.first[r - i], b.first[r - i + 1])]
                    assert got == words(texts[r])


def test_a_text_longer_than_a_block():
    import pyarrow as pa

    t = "word " * 300_000
    (_, _, b), *rest = tb.blocks(pa.array([t]), tb.SPACED)
    assert not rest and len(np.unique(b.hashes())) == 1 and b.counts.tolist() == [300_000]


# --- near duplicates


def shingle_set(t):
    w = spaced(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    comp = {d: d for d, _ in docs}

    def find(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for (a, _), (b, _) in itertools.combinations(docs, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in docs)


def test_minhash(spark):
    got = minhash.near_duplicates(docs_frame(spark))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == near_components(DOCS)
    kept = minhash.keep_one_of_each(docs_frame(spark))
    assert kept.columns == docs_frame(spark).columns
    assert rows(kept, "doc_id") == sorted([(d,) for d, _, c, k in near_components(DOCS) if k], key=repr)


def test_minhash_hot_group_without_a_centre(spark, monkeypatch):
    """Many copies of a text, each far from most others: hubs alone cannot settle it."""
    monkeypatch.setattr(minhash, "SQUARE", 16)
    r = random.Random(5)
    base, out = prose(60, r).split(), []
    for k in range(90):
        w = list(base)
        for _ in range(r.choice((1, 2, 2, 3))):
            w[r.randrange(60)] = f"x{r.random()}"
        out.append((k, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(out, SCHEMA))
    want = near_components(out)
    assert len({c for _, _, c, _ in want}) > 1
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == want


def test_pairs_within_the_distance_meet_under_a_key():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 1 << 16, minhash.SYMBOLS)
        b = a.copy()
        at = r.choice(minhash.SYMBOLS, minhash.MEET, replace=False)
        b[at] ^= 1
        same = (a == b).reshape(minhash.CHUNKS, minhash.WIDTH)
        assert (same.sum(1) >= minhash.WIDTH - minhash.ERRORS).any()


def test_minhash_repeated_rows_and_ids(spark):
    """Two hundred rows of each of two near copies are two nodes; an id with two texts stands for either."""
    a = prose(60)
    b, c = a + " tail", prose(60)
    many = spark.createDataFrame([(1, a), (2, b)] * 200 + [(3, c), (3, a), (4, c)], SCHEMA)
    got = minhash.near_duplicates(many).groupBy("doc_id", "component_id", "kept").count()
    assert rows(got, "doc_id", "component_id", "kept", "count") == [(1, 1, True, 200), (2, 1, False, 200), (3, 1, False, 1), (3, 3, True, 1), (4, 3, False, 1)]
    kept = minhash.keep_one_of_each(many)
    assert rows(kept, "doc_id", "text") == sorted([(1, a), (3, c)], key=repr)


def test_minhash_null_and_repeated_ids(spark):
    t = prose(30)
    got = minhash.near_duplicates(spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], SCHEMA))
    assert rows(got, "doc_id", "component_id", "kept") == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)


# --- decontamination


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = alnum(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, names = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[x]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, prose(25)), (2, "One"), (3, "two, WORDS!"), (10, prose(12)), (11, ""), (12, None), (13, "é" * 50), (None, "three short words")]
ITEMS += [(20, ITEMS[0][1]), (21, ITEMS[3][1] + " tail words")]
LEAKY = DOCS + [(9001, f"{prose(5)} {ITEMS[0][1].upper()} {prose(5)} {ITEMS[3][1]}"), (9002, " ".join(ITEMS[0][1].split()[4:15])), (9003, " ".join(ITEMS[0][1].split()[:9])), (9004, ITEMS[3][1].replace(" ", "--"))]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs_frame(spark, LEAKY), items, bound)
    want = contaminated(LEAKY, ITEMS)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontaminate.clean_of(docs_frame(spark, LEAKY), items, bound)
    assert rows(clean, "doc_id") == sorted([(r[0],) for r in want if not r[5]], key=repr) and clean.columns == docs_frame(spark).columns


def test_decontamination_without_items(spark):
    got = decontaminate.contamination(docs_frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert got.where("contaminated").count() == 0 and got.count() == len(DOCS)


# --- licences


def phrase_places(t):
    w, out = alnum(t), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(label, k) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return w, out


LICENSED = DOCS + [
    (7001, "All rights reserved. ALL RIGHTS, reserved"), (7002, f"{prose(20)} Licensed under CC BY-NC 4.0. {prose(20)}"), (7003, "GNU General Public License general public license"),
    (7004, "cc by cc by cc cc by"), (7005, licenses.TEMPLATES["mit"][2].title()), (7006, "released under the MIT license"), (7007, "all rights all rights reserved by cc"), (7008, "cc"),
    (7009, licenses.TEMPLATES["apache-2.0"][1].replace("compliance", "accord")), (7010, "general public"),
]


def test_licences(spark):
    got = {r["doc_id"]: r for r in licenses.license_report(docs_frame(spark, LICENSED)).collect()}
    for d, t in LICENSED:
        w, places = phrase_places(t)
        r, at = got[d], [k for _, k in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(at, default=None), max(at, default=None)), (d, t)
        base = {label for label, _ in places}
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert "mit" in got[7005]["labels"] and "mit" in got[7006]["labels"] and got[7008]["labels"] == "" and "apache-2.0" in got[7009]["labels"]


def test_whole_licences_with_edits():
    """A whole licence with words changed, dropped and added is one chained span; shares count the words that match."""
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    whole = max(licenses.TEMPLATES["mit"], key=len).split()
    w = [f"x{k}" for k in range(10)] + whole[:40] + ["odd"] + whole[41:90] + whole[92:] + [f"y{k}" for k in range(10)]
    import pyarrow as pa

    ((_, _, block),) = tb.blocks(pa.array([" ".join(w)]), tb.ALNUM)
    _, spans = scan(block)[0]
    label, start, end, covered, share = max(spans, key=lambda s: s[3])
    assert (label, start, end) == ("mit", 10, len(w) - 10) and covered == len(whole) - 3 and abs(share - covered / len(whole)) < 1e-9
    ((_, _, block),) = tb.blocks(pa.array(["published under cc by sa 4 0"]), tb.ALNUM)
    assert {s[0] for s in scan(block)[0][1]} == {"cc-by-sa"}


def test_matches_are_the_runs_that_cannot_go_on():
    """Against all places of all runs: those at least MIN_MATCH long that neither the text nor the template lets grow to the right, longest at their end."""
    r = random.Random(12)
    templates = {"a": [" ".join(r.choice("abcde") for _ in range(12))], "b": [" ".join(r.choice("abcde") for _ in range(9)) for _ in range(2)]}
    scan = licenses.Scanner(templates, {})
    for _ in range(60):
        words, got = [r.choice("abcdef") for _ in range(30)], []
        scan.stretch(words, 0, [], got)
        want = set()
        for end in range(1, 31):
            runs = [(n, k, e) for k, t in enumerate(scan.words) for e in range(1, len(t) + 1) for n in range(1, min(end, e) + 1) if t[e - n : e] == words[end - n : end]]
            n = max((x[0] for x in runs), default=0)
            here = [x for x in runs if x[0] == n]
            goes_on = end < 30 and any(e < len(scan.words[k]) and scan.words[k][e] == words[end] for _, k, e in here)
            if n >= licenses.MIN_MATCH and not goes_on:
                want |= {(k, end - n, end, e - n) for _, k, e in here}
        assert set(got) == want


def test_matching_statistics():
    r = random.Random(2)
    seqs = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(6)]
    a = licenses.Automaton(seqs)
    known = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text, s, l = [r.choice("abcd") for _ in range(300)], 0, 0
    for i, w in enumerate(text):
        while (t := a.next[s].get(w)) is None and s:
            s = a.link[s]
            l = a.len[s]
        s, l = (t, l + 1) if t is not None else (0, 0)
        want = max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in known)
        assert l == want
        if l:
            ends = {(k, e) for k, q in enumerate(seqs) for e in range(l, len(q) + 1) if q[e - l : e] == text[i + 1 - l : i + 1]}
            assert ends == {(k, e) for k, e in a.ends[s] if e >= l}


# --- tokens


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b <|startoftext|>", "ΑΣ Σ ΟΔΟΣ", "İstanbul Å ﬁ", "it's WE'LL", "\x1c a\x85b\u200b c", "日本語 ½²Ⅷ", "aaaa" * 500, "<|endoftext", "😀👩‍👩‍👧 1234!!??"]
    docs = DOCS[:60] + [(5000 + k, t) for k, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in tokencount.token_counts(docs_frame(spark, docs), P.path("word_bpe_49k.json"), 20).collect()}
    for d, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[d]["n_tokens"], got[d]["n_bytes"], got[d]["over_limit"]) == (n, len((t or "").encode()), n > 20), t


def test_token_counts_of_nothing_and_of_much(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    assert tokencount.token_counts(docs_frame(spark).limit(0), path).count() == 0
    long = DOCS[-1][1] + " " + "y" * 20000
    got = tokencount.token_counts(docs_frame(spark, [(1, long), (1, long)]), path).collect()
    assert [r["n_tokens"] for r in got] == [len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)] * 2
    with pytest.raises(ValueError):
        tokencount._normaliser({"type": "Sequence", "normalizers": [{"type": "StripAccents"}]})


# --- mixing


def water(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


def test_mixing(spark):
    docs = DOCS + [(10_000 + k, prose(rnd.randint(0, 40))) for k in range(600)]
    df = docs_frame(spark, docs)
    got = mixing.mixture(df).collect()
    source = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    sizes, taken, most = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        most[s] = max(most.get(s, 0), r["size"])
    text = dict(docs)
    want = water(sizes)
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == len(SPACED.findall(text[r["doc_id"]] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sizes[source[r["doc_id"]]] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(df.repartition(7)).collect()))


def test_mixing_is_fair(spark):
    """Over many sources alike, each place of a document is taken about as often as it is due."""
    rows_ = [(s * 100 + k, f"s{s}", "w " * (k + 1)) for s in range(120) for k in range(6)]
    df = spark.createDataFrame(rows_, "doc_id long, source string, text string")
    got = mixing.mixture(df, weights=(1.0,), share=0.5).collect()
    for k in range(6):
        share = np.mean([r["copies"] for r in got if r["doc_id"] % 100 == k])
        assert abs(share - 0.5) < 0.2


def test_mixing_deals_rows_that_are_alike(spark):
    """Null ids of one size and source, more than a run of them: no group of the fold gathers them, and words come near the target."""
    n = mixing.RUN + 904
    df = spark.createDataFrame([(None, "s", "a b")] * n + [(7, "t", "a")] * 9, "doc_id long, source string, text string")
    got = mixing.mixture(df).groupBy("doc_id", "size", "target").agg(F.count("*").alias("rows"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 2 and by[None]["rows"] == n and by[7]["rows"] == 9 and by[7]["most"] <= 2 and by[None]["most"] <= 4
    assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)
    alike = mixing._numbered(spark.createDataFrame([(None, 2, n)], "doc_id long, size long, copies_of long"))
    groups = alike.groupBy(F.pmod(F.xxhash64(F.xxhash64("doc_id", "size", "at"), F.lit(0)), F.lit(-(-n // mixing.FAN)))).count()
    assert alike.count() == n and groups.agg(F.max("count")).first()[0] < 3 * mixing.FAN


def test_mixing_nothing(spark):
    assert mixing.mixture(docs_frame(spark).limit(0)).count() == 0
    z = mixing.mixture(docs_frame(spark, [(1, ""), (2, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in z] == [(0, 0.0, 0)] * 2


# --- chat


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user\n", "a\\", "|", "<", "", None, "\\n\n", "<|image|>"]
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, None, None, "x"), (3, 0, "as|sis\ntant\\n", "y"), (None, 0, "user", "z"), (2, None, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_turns(df)
    for r in out.join(df, [out["conv_id"].eqNullSafe(df["conv_id"]), out["turn"].eqNullSafe(df["turn"])]).select("formatted", "role", "text").collect():
        role, texts = chat.read_back(r["formatted"])
        assert (role, "".join(texts)) == (r["role"] or "", r["text"] or "")
        assert r["formatted"].count("<|") == 2
    d = {r["conv_id"]: r for r in chat.conversation_digests(out).collect()}
    said = "".join((t or "") for k, t in enumerate(hard) if k % 2)
    assert d[1]["loss_chars"] == len(said) and d[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = "".join(f"{'assistant' if k % 2 else 'user'}\n{t or ''}\n" for k, t in enumerate(hard))
    assert d[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and d[2]["n_turns"] == 2 and d[None]["n_turns"] == 1


def test_chat_parts(spark):
    part = lambda type, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type, text, ref, width, height, seconds, pages)
    parts = [part("text", "look <"), part("image", ref="a.png", width=56, height=29), part("text", "|image|> and"), part("audio", ref="b", seconds=2.0), part("document", ref="c", pages=2), part("odd", ref="d"), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert [tuple(x) for x in a["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b", 50), (2, "document", "c", 1024), (3, "file", "d", 1)]
    assert a["n_tokens"] == 2 + 4 + 2 + 50 + 1024 + 1
    assert chat.read_back(a["formatted"])[1] == ["look <", "|image|> and", "", "", ""]
    assert a["loss"] == [] and b["loss"] == []
    said = spark.createDataFrame([(1, 0, "assistant", parts, "x" * 200_000)], f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")
    r = chat.format_turns(said).first()
    assert [chat.unescaped(r["formatted"][x["start"] : x["end"]]) for x in r["loss"]] == ["look <", "|image|> and"]
    assert b["attachments"] == [] and b["n_tokens"] == 0


# --- HTML


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<p>a<p>b <b>c</b>\n d", "a\n\nb c d"),
        ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", "- x\n- y\n  3. z\n  4. w"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<div>a<div hidden>no</div><span style='display: none'>no</span><script>no</script>b</div>", "ab"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<head><title>t</title></head><body>&lt;b&gt; &amp;</body>", "<b> &"),
        ("</div></p>text<b><i>k</b>", "textk"),
        ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<!-- c -->a<!DOCTYPE html>b", "ab"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<select><option>o1<option>o2</select>", "o1\no2"),
        ("<table><tr><td rowspan=2>a<td>bb<tr><td>d</table>", "a  bb\n   d"),
        ("<table><tr><td colspan=2>a<td>x<tr><td>ccc<td>d<td>e</table>", "a       x\nccc  d  e"),
        ("<input type=checkbox value=on>agree<input type=password value=secret><input value=name>", "agreename"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<svg><title>t</title><defs><text>no</text></defs><text>A</text><text>B</text></svg><math><mi>x</mi></math><object>o</object>", "A\nB\nxo"),
    ],
)
def test_html(html, text):
    assert htmltext.page_text(html) == text


def test_html_deep_and_broken(spark):
    assert htmltext.page_text("<div>" * 20000 + "deep") == "deep"
    assert "x" in htmltext.page_text("<table><tr><td>" * 60 + "x")
    df = spark.createDataFrame([(1, None, "u"), (2, "<p>a<p>b", "u"), (2, "<p>a<p>b", "u")], "page_id long, html string, text string")
    assert rows(htmltext.extract_pages(df), "page_id", "text", "n_lines") == sorted([(1, "", 0), (2, "a\n\nb", 3), (2, "a\n\nb", 3)], key=repr)


VISIBLE = ["", "", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'"]


def grow(r, depth, seen, words):
    """(html, visible words in order) of random content, end tags left out where HTML allows it."""
    out, told = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["text", "text", "div", "p", "ul", "b", "pre", "h2", "blockquote"]) if depth else "text"
        if kind == "text":
            w = f"w{next(words)}"
            out.append(r.choice([" ", "\n", "  "]) + w + " ")
            told += [w] * seen
            continue
        how = r.choice(VISIBLE)
        inner = False if "hidden" in how or "none" in how else True if "visible" in how else seen
        none = how in (" hidden", " style='display:none'")
        if kind == "ul":
            items = [grow(r, depth - 1, inner and not none, words) for _ in range(r.randint(1, 3))]
            out.append(f"<ul{how}>" + "".join(f"<li>{h}" + r.choice(["", "</li>"]) for h, _ in items) + "</ul>")
            told += [w for _, t in items for w in t] if not none else []
        elif kind in ("p", "b", "h2", "pre"):
            w = f"w{next(words)}"
            out.append(f"<{kind}{how}>{w} </{kind}>")
            told += [w] * (inner and not none)
        else:
            h, t = grow(r, depth - 1, inner and not none, words)
            out.append(f"<{kind}{how}>{h}</{kind}>")
            told += t if not none else []
    return "".join(out), told


def test_html_shows_what_is_visible():
    """Random pages against the words that their tree shows; words under display:none stay out whatever is inside."""
    r = random.Random(6)
    for _ in range(400):
        # inside display:none nothing may be switched on again, so such parts hold no visibility
        html, told = grow(r, 3, True, itertools.count())
        if re.search(r"(?:hidden>|none'>).*visible", html):
            continue
        got = [w for w in htmltext.page_text(html).split() if w != "-"]
        assert got == told, html


def test_html_tables_on_a_grid():
    """Cells of random tables with spans stand where a brute-force grid puts them."""
    r = random.Random(9)
    for _ in range(300):
        rows_, taken, where, name, html = r.randint(1, 5), set(), {}, itertools.count(), ""
        for y in range(rows_):
            html, x = html + "<tr>", 0
            for _ in range(r.randint(1, 4)):
                while (y, x) in taken:
                    x += 1
                wide, tall, word = r.choice((1, 1, 1, 2)), r.choice((1, 1, 1, 2, 3)), f"c{next(name)}"
                wide = 1 if (y, x + 1) in taken else wide  # cells over one another are an error of the page
                html += f"<td colspan={wide} rowspan={tall}>{word}"
                where[word] = (y, x)
                taken |= {(y + b, x + a) for a in range(wide) for b in range(tall)}
                x += wide
        lines = htmltext.page_text(f"<table>{html}</table>").split("\n")
        left = {}
        for word, (y, x) in where.items():
            m = re.search(rf"\b{word}\b", lines[y])
            assert m and left.setdefault(x, m.start()) == m.start(), (html, lines)
        assert [left[x] for x in sorted(left)] == sorted(left.values())


def test_html_costs_what_the_page_does():
    import time

    for html, least in (("<table>" + "<tr><td>" + "x" * 40000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>", 44000), ("<table><tr>" + "<td>a" * 500 + "<td>" + "line<br>" * 3000 + "</table>", 12500)):
        text = htmltext.page_text(html)
        assert least <= len(text) < 3 * len(html)
    t = time.time()
    assert htmltext.page_text("<p><button>" + "<div>" * 60_000 + "deep") == "deep"
    htmltext.page_text("<table><tr>" + "".join(f"<td rowspan={k}>a" for k in range(2, 3000)) + "<tr><td>b" * 3000 + "</table>")
    assert time.time() - t < 40


# --- empty tables


def test_empty_tables(spark):
    none = docs_frame(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        minhash.near_duplicates(none), decontaminate.contamination(none, items), licenses.license_report(none), quality.quality_scores(none, labels), toxicity.toxicity_scores(none, labels),
        vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")), htmltext.extract_pages(spark.createDataFrame([], "page_id long, html string")),
        chat.conversation_digests(chat.format_turns(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>"))),
        quality.good_documents(none, labels), toxicity.clean_documents(none, labels), minhash.keep_one_of_each(none), decontaminate.clean_of(none, items),
    ):
        assert df.count() == 0
    assert quality.quality_scores(docs_frame(spark), labels).where("score = 0.5 and predicted = 1").count() == len(DOCS)
    assert toxicity.toxicity_scores(docs_frame(spark), labels).where("score = 0 and predicted = 0").count() == len(DOCS)
