import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.llm import gbt, history, markup, mixing, packing, percentiles, pii, secrets, spam, tagger, tokens

# Strings that look like keys are put together here, so that none stands in the file.
KEY = "AKIA" + "3PJVJR5JPLEZHLRF"


def test_percentiles_against_sorting(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "b", None]), r.choice([r.randrange(-50, 50), r.randrange(10**12), None]), 1) for _ in range(3000)] + [("one", 5, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v long, n int")
    got = {(x["g"], x["permille"]): (x["n"], x["value"]) for x in percentiles.percentiles(df.drop("n"), ["g"], "v").collect()}
    groups = {g for g, v, _ in rows if v is not None}
    for g in groups:
        vs = sorted(v for k, v, _ in rows if k == g and v is not None)
        for p in percentiles.PERMILLES:
            assert got[g, p] == (len(vs), vs[max(1, -(-p * len(vs) // 1000)) - 1])
    assert len(got) == 4 * len(groups)
    days = percentiles.summary(df.withColumn("day", F.col("v") % 3), ["g", "day"], "v")
    for x in percentiles.from_summary(percentiles.merge(days, ["g"]), ["g"]).collect():
        exact = got[x["g"], x["permille"]][1]
        assert x["low"] <= exact <= x["high"] and x["high"] - x["low"] <= max(1, abs(exact)) / 32
    assert percentiles.percentiles(df.limit(0).drop("n"), ["g"], "v").count() == 0
    floats = spark.createDataFrame([("a", float(i) / 10) for i in range(101)], "g string, v double")
    for x in percentiles.percentiles(floats, ["g"], "v", step=0.01).collect():
        assert abs(x["value"] - 10 * x["permille"] / 1000) < 0.11
    with pytest.raises(ValueError):
        percentiles.percentiles(floats, ["g"], "v")


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, r.choice([100, 100, r.randrange(1, 300), 512, 700, 1100]), 0) for i in range(600)] + [(1000, 0, 0), (1001, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, z long, bin int")
    out = packing.pack(df.drop("bin"), ["doc_id"], "z", 512).collect()
    load, back = Counter(), Counter()
    for x in out:
        load[x["bin"]] += x["piece_size"]
        back[x["doc_id"]] += x["piece_size"]
    assert max(load.values()) <= 512 and back == Counter({i: z for i, z, _ in rows if z})
    assert all(sum(1 for x in out if x["doc_id"] == i) == 1 for i, z, _ in rows if z and z <= 512)
    assert sum(load.values()) / (512 * len(load)) > 0.97
    assert packing.pack(df.limit(0), ["doc_id"], "z", 512).count() == 0


def test_nnls_reaches_the_histogram():
    combos, times = np.array([[1, 2, 0], [3, 0, 0], [1, 2, 0]]), np.array([[1, 1, 0], [1, 0, 0], [2, 1, 0]])
    h = np.array([30.0, 20.0, 7.0])
    x = packing.nnls(combos, times, h, enough=1e-9)
    a = np.zeros(4)
    for c in range(3):
        a += np.bincount(combos[:, c], weights=x * times[:, c], minlength=4)
    assert np.allclose(a[1:], h, atol=0.5) and (x >= 0).all()
    assert packing.rounded(np.array([0.4, 2.5, 0.3, 0.9])).sum() == 4


def test_combinations_reach_all_lengths():
    """Capacity 8192 with every length present: combinations with largest lengths over the whole range, each filling the container."""
    lengths = np.arange(1, 8193)
    combos, times = packing.combinations(lengths, 8192, 16)
    total = (np.concatenate([[0], lengths])[combos] * times).sum(axis=1)
    assert total.min() >= 8192 - 16 and total.max() <= 8192
    assert len(np.unique(combos[:, 0])) > 8000 and len(combos) < 4 * packing.AIM_COMBINATIONS
    plan = packing.plan({int(z): 3 for z in range(1, 1200)}, 8192)
    assert sum(z * m * t for need, t in plan for z, m in need.items()) == 3 * sum(range(1, 1200))
    assert all(sum(z * m for z, m in need.items()) <= 8192 for need, _ in plan)


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a"] * 6 + ["b", None, "other"]), r.randrange(1, 400)) for i in range(3000)] + [(9000, "a", 0)]
    recs = spark.createDataFrame(rows, "record long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 3), ("m", "gone", 0.2, 2)], "mix string, source string, target_share double, max_repeats int")
    out = mixing.mix(recs, targets)
    assert out.agg(F.max(F.when(F.col("source") == "a", F.col("copies")))).first()[0] <= 2
    rep = {x["source"]: x for x in mixing.shares(out, targets).collect()}
    assert abs(rep["a"]["actual_share"] - 0.625) < 0.01 and abs(rep["b"]["actual_share"] - 0.375) < 0.01 and rep["gone"]["tokens"] == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(recs.repartition(3), targets).collect()))
    assert mixing.mix(recs.limit(0), targets).count() == 0


def test_history_batches_equal_one_pass(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda n=120: " ".join(r.choice(words) for _ in range(n))
    old = [text() for _ in range(40)]
    edit = lambda t, k: " ".join(w if j % k else "changed" for j, w in enumerate(t.split()))
    new = [old[0], old[1].upper() + "!!", edit(old[2], 12), edit(old[3], 2), text(), "", "", None, text(3), edit(old[4], 30)]
    new += [new[4], edit(new[4], 15)] + [edit(old[5], 9)] * 30
    docs = [(1000 + i, t) for i, t in enumerate(new)]
    hist = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(old)], "id long, content string")

    def run(path, batches):
        h = history.History(spark, str(tmp_path / path))
        h.add(hist)
        out = {}
        for b in batches:
            h = history.History(spark, str(tmp_path / path))
            out |= {x["id"]: x["match"] for x in h.check(spark.createDataFrame(b, "id long, content string")).collect()}
        return out

    got = run("one", [docs])
    assert got == run("many", [docs[:4], docs[4:9], docs[9:]])
    want, seen = {}, list(old)
    for i, t in docs:
        if t is None:
            continue
        ws = re.findall(r"[^\W_]+", t.lower())
        if t in seen:
            want[i] = "exact"
        elif any(history.close(ws, re.findall(r"[^\W_]+", s.lower())) for s in seen):
            want[i] = "near"
        seen.append(t)
    assert got == want
    assert run("none", [docs[:0]]) == {}


def test_history_finds_scattered_edits_in_a_large_group(spark, tmp_path):
    """Near copies at the four-fifths border, every fifth word changed, so that no run of five words stays."""
    r = random.Random(16)
    words = [f"w{i}" for i in range(400)]
    old = [r.choice(words) for _ in range(100)]
    change = lambda k, start: " ".join(f"x{r.randrange(10**9)}" if j % k == start else w for j, w in enumerate(old))
    near = [change(5, i % 5) for i in range(1000)] + ["w1 w2 w3 w4"]
    far = [change(3, i % 3) for i in range(20)]
    hist = spark.createDataFrame([(-1, " ".join(old)), (-2, "w1 w2 w3 w4 w5")], "id long, content string")
    docs = [(i, t) for i, t in enumerate(near + far)]
    h = history.History(spark, str(tmp_path / "group"))
    h.add(hist)
    got = {x["id"]: x["match"] for x in h.check(spark.createDataFrame(docs, "id long, content string")).collect()}
    assert got == dict.fromkeys(range(len(near)), "near")


def test_history_batches_leave_nothing_on_the_driver(spark, tmp_path):
    """Broadcasts of a batch that is done don't stay in the driver's memory."""
    h = history.History(spark, str(tmp_path / "h"))
    h.add(spark.createDataFrame([(-1 - i, f"old text {i} " * 20) for i in range(50)], "id long, content string"))
    store, held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore(), []
    for b in range(3):
        h.check(spark.createDataFrame([(1000 * b + i, f"new text {i} of {b} " * 20) for i in range(50)], "id long, content string"))
        for _ in range(20):  # Spark cleans in the background
            time.sleep(0.25)
            if held and store.memoryUsed() <= held[0] + (1 << 20):
                break
        held.append(store.memoryUsed())
    assert held[-1] <= held[0] + (1 << 20), held


@pytest.mark.parametrize("k", [4, 5, 6])
def test_history_finds_evenly_spread_edits(spark, tmp_path, k):
    """Every k-th word changed, inserted or removed; probing alone sees none of them for k = 4 and 5."""
    r = random.Random(18)
    words = [f"w{i}" for i in range(3000)]
    old = [r.choice(words) for _ in range(400)]
    cases = {0: [w if j % k else f"x{j}" for j, w in enumerate(old)], 1: [w for j, w in enumerate(old) if j % k], 2: [x for j, w in enumerate(old) for x in ([w] if j % k else [w, f"x{j}"])]}
    h = history.History(spark, str(tmp_path / "h"))
    h.add(spark.createDataFrame([(-1, " ".join(old)), (-2, " ".join(r.choice(words) for _ in range(400)))], "id long, content string"))
    got = {x["id"]: x["match"] for x in h.check(spark.createDataFrame([(i, " ".join(t)) for i, t in cases.items()], "id long, content string")).collect()}
    assert got == {i: "near" for i, t in cases.items() if history.close(old, t) or i and history.close(cases[0], t)}


def test_history_block_equals_brute_force(monkeypatch):
    """Texts of all lengths, with edits around the border, in small slices and groups."""
    monkeypatch.setattr(history, "GROUP", 7)
    monkeypatch.setattr(history, "DENSE", 3)
    r = random.Random(19)
    vocab = [r.randrange(-(2**31), 2**31) for _ in range(60)]
    texts: list[list[int]] = []
    for _ in range(300):
        t = list(r.choice(texts)) if texts and r.random() < 0.5 else [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 10, 15, 16, 17, 20, 23, 24, 30, 60, 100]))]
        for _ in range(int(len(t) * r.uniform(0, 0.45))):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = [r.choice(vocab)] * r.randrange(2)
        texts.append(t or [vocab[0]])
    arrays = [np.array(t, dtype=np.int32) for t in texts]
    block, got = history.Block(list(range(300)), arrays), set()
    order = sorted(range(300), key=lambda i: len(texts[i]))
    for k in range(0, 300, 37):
        got |= set(block.against(np.array(order[k : k + 37]), [arrays[i] for i in order[k : k + 37]]))
    assert got == {i for i in range(300) if any(history.close(texts[i], texts[j]) for j in range(i))}


def test_history_counts_little_one_by_one(monkeypatch):
    """Texts of four languages with few words each: little is counted besides the product of matrices, and nothing close is lost."""
    import pyarrow as pa

    r = random.Random(23)
    vocab = [[r.randrange(-(2**31), 2**31) for _ in range(150)] for _ in range(4)]
    texts: list[list[int]] = []
    for i in range(400):
        t = list(r.choice(texts)) if i % 8 == 7 else r.choices(vocab[i % 4], [1 / (1 + k) for k in range(150)], k=r.randrange(60, 160))
        for at in r.sample(range(len(t)), int(len(t) * r.uniform(0, 0.35)) if i % 8 == 7 else 0):
            t[at] = r.choice(vocab[i % 4])
        texts.append(t)
    counted, bincount = [], np.bincount
    monkeypatch.setattr(history.np, "bincount", lambda x, **k: counted.append(len(x)) or bincount(x, **k))
    monkeypatch.setattr(history, "SLICE_WORDS", 4000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts, pa.list_(pa.int32()))], names=["id", "words"])
    found = [b.column("qid").to_pylist() for b in history._compare(history.Block(list(range(400)), [np.array(t, dtype=np.int32) for t in texts]))(iter([batch]))]
    want = [i for i in range(400) if any(history.close(texts[i], texts[j]) for j in range(i))]
    assert sorted(sum(found, [])) == want and len(want) > 30
    assert sum(counted) < 0.3 * 400 * 400


def test_word_numbers_and_coordinates():
    import pyarrow as pa

    flat, ends = history.word_numbers(pa.array(["", "Hello, wörld_2!", "  ", "a b c d e f " * 9, "x"]))
    assert ends.tolist() == [0, 0, 3, 3, 57, 58]
    cells, stops = history.coordinates(flat, ends)
    for i in range(5):
        own, stop = history.coordinates(flat[ends[i] : ends[i + 1]], np.array([0, ends[i + 1] - ends[i]]))
        assert own.tolist() == cells[stops[i] : stops[i + 1]].tolist() and stop[-1] == len(own)
    assert history.word_numbers(pa.array([], pa.string()))[0].size == 0


def test_common_subsequence():
    r = random.Random(7)
    for _ in range(50):
        a, b = [r.randrange(5) for _ in range(r.randrange(20))], [r.randrange(5) for _ in range(r.randrange(20))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert history.common_subsequence(a, b) == t[-1][-1]


def test_secrets():
    good = ['password = "Chunk-skewed!76"', "dsn: amqp://rw:6lRlSIc16GDmmkeb@db.example:1/x", f"export S3_USER='{KEY}'", "-----BEGIN " + "RSA PRIVATE KEY-----", "# fallback password: CitationPartial72"]
    bad = ['password = "${DB_PASSWORD}"', 'api_key = os.environ["API_KEY"]', 'commit = "d627a34df57475383653467486494cdea857c2df"', 'secret_name = "queue-audit"', "token_file: /run/creds/a.tok", "password: !vault search/db", "if token == expected_token: pass", "passport no. F19019347 au guichet", None, ""]
    for g in good:
        assert secrets.lines("x\r\n" + g + "\ny") == [2], g
    for b in bad:
        assert secrets.lines(b) == [], b
    text = "a = 1\n" + "\n".join(good) + "\nz"
    red = secrets.redact(text)
    assert len(red) == len(text) and red.count("\n") == text.count("\n") and "skewed" not in red and KEY not in red and red.startswith("a = 1\npassword = \"X")
    assert secrets.chars_per_token("ordinary words here") > 3 > secrets.chars_per_token("kJrZkQbzXV8X7qTmWp2")


def test_secrets_by_each_rule_alone():
    """Lines whose only sign is a rule's own literal, and credentials longer than a few hundred characters."""
    r = random.Random(17)
    key = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    alone = ["x = " + "AIza" + key(35), "x = " + "SG." + key(22) + "." + key(43), "id " + "ASIA" + key(16).upper(), f"curl --user bob:{key(12)} https://a.example/x", "pay " + "sk_" + "live_" + key(13), "x " + "abcdef" + "_pat_" + key(20)]
    alone += [f"{name} = '{key(40)}'" for name in ("signature", "sas", "PAT", "githubPat", "AZURE_SAS")] + [f"'Basic {key(40)}'", f'password = "{key(201)}"', f'token = "{"documents-and-notes-" * 25}{key(4000)}"']
    for g in alone:
        assert secrets.lines("x\n" + g) == [2], g
    for b in ("PATH=/usr/bin", "export pattern='abc'", "Asia/Tokyo", "basic training of the team", f"path = '{key(3)}'"):
        assert secrets.lines(b) == [], b


def test_secrets_without_caps():
    """Long names, long passwords, remarks, and a private key that is cut off."""
    for line in ("# TODO remove, pw=9%vDhpmt1PQOH7q", "# old login crawl_admin / 0c7PSiMYzCZs9k7q", "x" * 200 + "_password = 'Chunk-skewed!76'", 'password = "' + "aB3!" * 100 + '"', "1password=Chunk-skewed!76x"):
        assert secrets.lines(line) == [1], line
        assert len(secrets.redact(line)) == len(line)
    for line in ("# the old login page / index", "pw = os.environ['PW']", "login user / password"):
        assert secrets.lines(line) == [], line
    body = "\n".join("MIIEpAIBAAKCAQEA7bq2Lk9XwTn5vY8rZ1sD4fG6hJ3mP0cVxQeRtUyIoA" for _ in range(3))
    text = "k = '''-----BEGIN " + "RSA PRIVATE KEY-----\n" + body + "\nQxavWC3vh4zxL==\n'''\ndef f(x):\n    return x + 1\n"
    red = secrets.redact(text)
    assert "MIIE" not in red and "QxavWC" not in red and red.endswith("\n'''\ndef f(x):\n    return x + 1\n") and len(red) == len(text)
    compile(red, "redacted", "exec")
    long = "a-" * 20_000 + " x_1y" * 20_000
    assert secrets.lines(long + " token") == []


def test_redacted_source_files_still_parse():
    """Every source file of the small table that parses does so after redaction, and no reported line keeps a credential."""
    import ast

    import pyarrow.parquet as pq

    parsed = 0
    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "file_path"]).to_pylist():
        text = r["text"] or ""
        red = secrets.redact(text) or ""
        assert len(red) == len(text) and red.count("\n") == text.count("\n")
        still, rows = secrets.lines(red), red.split("\n")
        assert all(secrets._PRIVATE.search(rows[no - 1]) for no in still)
        if r["file_path"].endswith(".py"):
            try:
                ast.parse(text)
            except (SyntaxError, ValueError):
                continue
            ast.parse(red)
            parsed += 1
    assert parsed > 20


def test_redaction_of_escaped_lines():
    import html

    for line, gone, kept in (
        ("<pre>password = &quot;Chunk-skewed!76&quot;</pre>", "skewed", ("<pre>password = &quot;X", "X&quot;</pre>")),
        ("password = &#34;Chunk&amp;skewed!76&#34; &lt;b&gt; &copyx &nosuch; &", "skewed", ("password = &#34;X", "X&#34; &lt;b&gt; &copyx &nosuch; &")),
        ("password = &quot;&#59;Chunk-skewed!76&semi;&quot;", "skewed", ("password = &quot;XXXXXX", "XXXXXXX&quot;")),
        ('a && password = "Chunk-skewed!76" && b', "skewed", ('a && password = "X', 'X" && b')),
    ):
        plain, starts, ends = secrets._unescaped(line)
        assert plain == html.unescape(line) and len(plain) == len(starts) == len(ends)
        red = secrets.redact("x\n" + line + "\ny")
        assert secrets.lines(line) == [1] and gone not in red and len(red) == len(line) + 4
        assert red.startswith("x\n" + kept[0]) and red.endswith(kept[1] + "\ny"), red


def test_trees_learn_and_markup():
    r = np.random.default_rng(8)
    x = r.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    assert ((gbt.fit(x, y).predict(x) > 0) == y).mean() > 0.97
    yes = ["# Title\n\ntext", "<p>x</p>", "see [a](http://b.example/c)", "== Head ==\ntext", "\\section{A}\ntext", "a **bold** word", "x &nbsp;y"]
    no = ["", "plain text", "- item\n- other", "The rule fires when x < 3 and y > 44.", "It costs $36 per month, or $92 per year.", "R&D read values[7] as 6 * 8 = 21.", "Look under C:\\temp\\module or ~/traces first.", "Questions go to <a.b@example.net>.", "--- Slide 5 ---\ntext"]
    assert markup.holds_markup(yes, [False] * len(yes)) == [True] * len(yes)
    assert markup.holds_markup(no, [False] * len(no)) == [False] * len(no)
    doc = "<h2>Head</h2>\n<ul>\n<li>one</li>\n</ul>\n<pre><code>a &lt; b</code></pre>\n<p>see $x^2$ &amp; <b>this</b></p>"
    (nodes, keep), = markup.decisions([doc], [False])
    out = markup.clean(doc, nodes, keep)
    assert "## Head" in out and "- one" in out and "a < b" in out and "$x^2$ & this" in out and "<" not in out.replace("a < b", "")


def _cleaned(doc, md=False):
    ((nodes, keep),) = markup.decisions([doc], [md])
    return markup.clean(doc, nodes, keep)


def test_markup_conversion_keeps_text():
    tex = "\\documentclass{article}\n\\title{On Queues}\n\\author{Ada Byron}\n\\section{Start}\nSee \\href{http://a.example/x}{the guide} and \\textbf{this}; $x^2$ and \\frac{a}{b}.\n\\begin{itemize}\n\\item one\n\\end{itemize}\n"
    out = _cleaned(tex)
    assert all(w in out for w in ("On Queues", "Ada Byron", "# Start", "the guide", "this", "$x^2$", "\\frac{a}{b}", "- one")) and "{the guide}" not in out and "itemize" not in out
    wiki = "== Head ==\nIt is {{convert|5|km}} long.\n{{Infobox lake\n| name = Blue Lake\n| depth = 12 m\n}}\n'''Bold''' [[Page|shown]] text.\n"
    out = _cleaned(wiki)
    assert all(w in out for w in ("## Head", "5 km", "name: Blue Lake", "depth: 12 m", "Bold shown text")) and "{{" not in out and "'''" not in out
    page = '<h1>T</h1><p>Before <img src="a.png" alt="a chart"> after</p><table><tr><td>1</td><td>2</td></tr></table>'
    out = _cleaned(page)
    assert "# T" in out and "a chart" in out and "1 | 2" in out and "<" not in out
    md = "---\ntitle: Notes\n---\n# Head\n\n[![logo](l.png)](http://a.example) and [link](http://b.example)\n\n```py\na = [1](2)\n```\n"
    out = _cleaned(md, True)
    assert "title: Notes" in out and "# Head" in out and "logo" in out and "a = [1](2)" in out and "http://b" not in out


def test_markup_of_any_length():
    formula = "x_{1} + " * 200 + "y^2"
    assert _cleaned(f"# A\n\n$${formula}$$\n") == f"# A\n\n$${formula}$$"
    name = "many words " * 60
    assert "](" not in _cleaned(f"see [{name}](http://a.example/x) end") and "[[" not in _cleaned(f"== H ==\n[[{name}]] end")
    assert markup.holds_markup(["[" * 20_000 + "$" * 3], [False]) in ([True], [False])


def test_cleaned_documents_keep_their_words():
    """Of the visible words of every document with markup, nearly all are in the clean text, and code blocks stay whole."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "file_path"]).to_pylist() if r["text"]]
    got = markup.decisions([r["text"] for r in rows], [r["file_path"].endswith(".md") for r in rows])
    for r, (nodes, keep) in zip(rows, got, strict=True):
        if re.search(markup.CODE_SUFFIX, r["file_path"]):
            continue
        out = markup.clean(r["text"], nodes, keep)
        plain = re.sub(r"<[^<>]*>|https?://\S+|&\w+;|\\[a-z]+|\{[^{}]*\}", " ", r["text"])
        words, left = Counter(re.findall(r"[a-z]{4,}", plain.lower())), Counter(re.findall(r"[a-z]{4,}", out.lower()))
        assert sum((words - left).values()) <= 0.1 * sum(words.values()) + 3, (r["text"], out)
        for block in re.findall(r"(?ms)^```[^\n`]*\n(.*?)^```", r["text"]):
            assert block.strip() in out


def test_spam(spark):
    page = "\n".join(f"buy cheap lamp {c}" for c in "one two three four five six seven".split() * 8)
    prose = "The module checks the queue before the report opens, and the team reads the result. It was not easy to find the cause of the fault. " * 3
    r = random.Random(9)
    vocab = "queue report module team index cache table filter column record batch worker".split()
    rows = [(i, " ".join(f"The {r.choice(vocab)} reads the {r.choice(vocab)} and it is not in the {r.choice(vocab)} of our {r.choice(vocab)}." for _ in range(12)), r.choice(["en", "EN", None]), "a.md") for i in range(300)]
    rows += [(900, page, "en", "s.txt"), (901, prose, "en", "p.txt"), (902, page, "en", "s.py"), (903, None, None, None), (904, "", "xx", "e.txt"), (905, page, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, file_path string")
    assert {x["doc_id"] for x in spam.spam_pages(df).collect()} == {900, 905}
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_tagger_gradients():
    r = np.random.default_rng(0)
    m = tagger.Tagger.fresh(4, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    mask = np.array([[1] * 7, [1] * 5 + [0] * 2]).astype(bool)
    ids, flags, y = r.integers(0, 100, (2, 7)), r.random((2, 7, 3)), r.integers(0, 11, (2, 7)) * mask
    _, g = m.loss_and_grads(ids, flags, mask, y)
    for k in ("Wf", "Ub", "V", "A"):
        i = tuple(0 for _ in m.p[k].shape) if k != "A" else (int(y[0, 0]), int(y[0, 1]))
        m.p[k][i] += 1e-2
        up, _ = m.loss_and_grads(ids, flags, mask, y)
        m.p[k][i] -= 2e-2
        down, _ = m.loss_and_grads(ids, flags, mask, y)
        m.p[k][i] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][i]) < 1e-3


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(1)
    m = tagger.Tagger.fresh()
    n = len(tagger.TAGS)
    m.p["A"], m.p["s"] = r.random((n, n)).astype(np.float32), r.random(n).astype(np.float32)
    e = r.random((3, 1, n)).astype(np.float32)
    best = max(product(range(n), repeat=3), key=lambda p: m.p["s"][p[0]] + sum(e[t, 0, p[t]] for t in range(3)) + sum(m.p["A"][p[t], p[t + 1]] for t in range(2)))
    assert tuple(m.viterbi(e, np.array([3]))[0]) == best


def test_pii():
    texts = ["Contact: anna.kestwell@example.org", "Please ask Priya Kalvane before the next run.", "Call +1 617 555 0142 if the pager stays silent.", "The form lists SSN 922-22-3355 in the second box.", "Pick up at 6430 Tannery Ave, Nordheim, OR 61451", "Clone git@forge.example:a/b.git first.", "Atlas Core was restarted twice.", "Build 2025.4.847.8560 runs on 10.19.51.110.", "", None]
    allowed = pii.allow_pattern(["Atlas Core", None])
    got = pii.read(["" if t is None else t for t in texts], allowed)
    assert [{k for *_, k in s} for s in got] == [{"email"}, {"person"}, {"phone"}, {"id_number"}, {"address"}, set(), set(), set(), set(), set()]
    assert pii.redact(texts[0], got[0]) == "Contact: [EMAIL]" and pii.redact(None, []) is None
    long = "The cursor drops the index. " * 3000
    assert pii.read([long + texts[1] + long], allowed)[0][0][2] == "person"


def test_pii_after_equals_signs_and_in_long_words():
    texts = ["Form: ssn=922-22-3355 was sent.", "config phone=617-555-0142 stays", "build=2025.4.847.8560 sha=9f8e7d6c5b4a", "x=1234567890123456789012"]
    assert [{k for *_, k in s} for s in pii.read(texts)] == [{"id_number"}, {"phone"}, set(), set()]
    assert [len(x) for x in pii._batches([0, 1, 2], [10, pii.WINDOW * pii.BATCH_WINDOWS // 2, 10**6])] == [2, 1]
    long = "Call +1 617 555 0142 " * 3000
    (spans,) = pii.read([long])
    assert len(spans) == 3000 and "617" not in pii.redact(long, spans)


def test_windows_cover_everything():
    for n in (1, 96, 97, 150, 1000):
        w = pii._windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(a2 <= b1 - pii.OVERLAP or n <= pii.WINDOW for (_, b1), (a2, _) in zip(w, w[1:], strict=False))


def test_tokens():
    t = "word " * 10 + "a" * 10_000 + " tail"
    assert tokens.count(t) == len(tokens.encoder().encode_ordinary(t)) and tokens.count(None) == 0 and tokens.count("") == 0
    assert tokens.count("hello world") == 2
