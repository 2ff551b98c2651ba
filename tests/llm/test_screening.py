import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetloom.llm import licenses, pii, quality, urls

from .helpers import SCHEMA, WORD, corpus, frame, prose

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b@c.de a.b%c+d-e@x-y.z. @x.y q@w q@.w u@v..w", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111x 41111111111111112", "+49 (30) 1234567 +1 +12345678 ++49-30-1234567- +4930123456789012",
    "é😀 x@y.zz 10.0.0.1", "x@y.z" * 30, "1" * 400, "+" * 50 + "1 2" * 30, "a." * 300 + "@b.c", "1.1." * 100, None, "", "no data", "me@home.example.org\n+49 170 1234567",
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("01259 .-+()@ab\n") for _ in range(120)) for _ in range(150)]
    rows = list(enumerate([*TRICKY, *noise]))
    got = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["base"]] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got == {i: base_spans(t) for i, t in rows}


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(4)
    rows = [f"{prose(rng, 20)} hotline: +49 30 {rng.randrange(10**6, 10**7)} {prose(rng, 9)}" for _ in range(30)]
    rows += [f"{prose(rng, 20)} hotline: 030/{rng.randrange(10**6, 10**7)} {prose(rng, 9)}" for _ in range(3)]
    rows += [f"{prose(rng, 20)} room: {i} {prose(rng, 9)}" for i in range(40)]
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in pii.personal_data(frame(spark, list(enumerate(rows)))).collect()}
    added = {i: [rows[i][x["s"] : x["e"]] for x in s if x not in b] for i, (b, s) in got.items() if len(s) > len(b)}
    assert set(added) == {30, 31, 32} and all(v[0].startswith("030/") for v in added.values())
    clean = {r["doc_id"]: r for r in pii.redact(frame(spark, list(enumerate(rows)))).collect()}
    assert "[PHONE]" in clean[30]["text"] and "030/" not in clean[30]["text"] and clean[40]["text"] == rows[40] and clean[30]["n_chars"] == len(clean[30]["text"])


def test_long_values_of_labels_are_whole(spark):
    rng = random.Random(15)
    rows = [f"{prose(rng, 20)} hotline: +49 30 {rng.randrange(10**6, 10**7)} {prose(rng, 9)}" for _ in range(30)]
    long = "x7" * 45
    rows.append(f"{prose(rng, 20)} hotline: {long} {prose(rng, 9)}")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, list(enumerate(rows)))).collect()}
    assert clean[30] == rows[30].replace(long, "[PHONE]")


def test_found_identifiers_seed_the_next_round(spark):
    rng = random.Random(22)
    number = lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"
    local = [f"030/{rng.randrange(10**6, 10**7)}" for _ in range(12)]
    rows = [f"{prose(rng, 20)} hotline: {number()} {prose(rng, 9)}" for _ in range(60)]
    rows += [f"{prose(rng, 20)} hotline: {x} {prose(rng, 9)}" for x in local[:11]]  # found by the label
    rows += [f"{prose(rng, 20)} ruf-uns-einfach-jederzeit-an: {x} {prose(rng, 9)}" for x in local]  # a label that only they seed
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, list(enumerate(rows)))).collect()}
    added = {i: [rows[i][x["s"] : x["e"]] for x in r["spans"] if x not in r["base"]] for i, r in got.items()}
    assert all(added[60 + i] == [x] for i, x in enumerate(local[:11])) and all(added[71 + i] == [x] for i, x in enumerate(local))
    one = pii.personal_data(frame(spark, list(enumerate(rows))), pii.Bootstrap(rounds=1)).where("doc_id = 82").first()
    assert one["spans"] == one["base"] == []


def test_values_keep_their_own_two_words(spark):
    rng = random.Random(23)
    rows = [f"{prose(rng, 20)}. please call +49 30 {rng.randrange(10**6, 10**7)} {prose(rng, 9)}" for _ in range(40)]
    rows.append(f"{prose(rng, 20)}. at 7 please call 030/7654321 {prose(rng, 9)}")  # `at 7 please` begins two words before
    r = pii.personal_data(frame(spark, list(enumerate(rows)))).where("doc_id = 40").first()
    assert [rows[40][x["s"] : x["e"]] for x in r["spans"]] == ["030/7654321"]


def test_personal_data_of_odd_tables(spark, tmp_path):
    assert pii.personal_data(frame(spark, [])).collect() == []
    frame(spark, [(1, "x@y.zz"), (1, "x@y.zz"), (None, "1.2.3.4"), (2, None)]).withColumnRenamed("lang", "base").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"], r["base_sha256"]) for r in pii.op1_personal_data(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(0, 0, 1, "ip:0:7", sha("ip:0:7")), (1, 1, 0, "email:0:6", sha("email:0:6")), (1, 1, 0, "email:0:6", sha("email:0:6")), (2, 0, 0, "", sha(""))]


def counted(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [t for _, t in corpus(7)] + ["a b c d e f g h " * 10, "x " * 100, "l1 w\nl1 w\n \nl2 # <b>\nl1 w", "\u00a0nbsp\u2003wide 木 \x0b\x0c end", "one two three four five six seven eight nine one two three four five six seven eight " + prose(rng, 50), "\r\n".join(["same line"] * 30)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counted(t), t and t[:80]
        assert not (r["base_failed"] and r["kept"])


def test_frequent_lines_go_and_depleted_documents_too(spark):
    rng = random.Random(8)
    banner = "Subscribe to our newsletter for the very latest news today"
    rows = [(i, f"{banner}\n{prose(rng, 60)}\n{banner.upper()}  ") for i in range(40)] + [(i, f"{banner}\n{prose(rng, 21)[:40]}\n" + f"{banner}\n" * 3) for i in range(40, 44)] + [(i, prose(rng, 60)) for i in range(50, 60)]
    docs = frame(spark, rows)
    kept = {r["doc_id"]: r for r in quality.apply_quality(docs).collect()}
    assert set(range(40)) | set(range(50, 60)) == set(kept)
    assert all("ubscribe" not in r["text"] and "SUBSCRIBE" not in r["text"] and r["n_chars"] == len(r["text"]) for r in kept.values())
    assert kept[55]["text"] == dict(rows)[55] and docs.columns == quality.apply_quality(docs).columns
    # exact copies count once: a text of forty copies makes none of its lines frequent
    copies = frame(spark, [(i, f"{banner}\nwith {prose(random.Random(1), 30)}") for i in range(40)])
    assert quality.frequent_lines(quality.line_table(copies)).count() == 0 and quality.apply_quality(copies).count() == 40
    assert quality.quality(frame(spark, [])).collect() == []


def test_lines_at_a_tenth_of_a_large_host_go(spark):
    rng = random.Random(9)
    banner = "Subscribe to our newsletter for the very latest news today"
    rows = [(i, f"{banner}\n{prose(rng, 60)}") for i in range(40)] + [(i, f"{banner}\n" * 9 + prose(rng, 25)) for i in range(40, 44)] + [(i, prose(rng, 60)) for i in range(44, 420)]
    rows += [(i, f"a line of few\n{prose(rng, 60)}") for i in range(420, 440)]  # at the limit, not above it
    docs = frame(spark, rows)
    assert [r["n_texts"] for r in quality.frequent_lines(quality.line_table(docs)).collect()] == [44]
    got = {r["doc_id"]: (r["n_lost_words"], r["kept"]) for r in quality.quality(docs).collect()}
    words = len(banner.split())
    assert all(got[i] == (words, True) for i in range(40)) and all(got[i] == (0, True) for i in range(44, 440))
    assert all(got[i] == (9 * words, False) for i in range(40, 44))
    # other hosts count for themselves
    apart = docs.withColumn("source", F.concat(F.lit("host-"), (F.col("doc_id") % 3).cast("string")))
    assert quality.frequent_lines(quality.line_table(apart)).count() == 0


def test_lines_are_lost_by_host(spark):
    rng = random.Random(19)
    banner = "Subscribe to our newsletter for the very latest news today"
    text = f"{prose(rng, 80)}\n{banner}\n{banner}"
    rows = [(i, f"{banner}\n{prose(rng, 60)}", "en", "host-a", 1) for i in range(40)] + [(100, text, "en", "host-a", 1), (100, text, "en", "host-b", 1), (100, text, "en", None, 1)]
    got = quality.quality(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 100").collect()
    assert {r["source"]: r["n_lost_words"] for r in got} == {"host-a": 2 * len(banner.split()), "host-b": 0, None: 0}
    clean = {r["source"]: r["text"] for r in quality.apply_quality(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 100").collect()}
    assert clean == {"host-a": text.split("\n")[0], "host-b": text, None: text}


def test_texts_of_very_many_words_and_spans_end(spark):
    rng = random.Random(20)
    words = prose(rng, 300_000, 10**6)
    spans = " ".join(f"u{i}@ex.org note: +49 30 {1000000 + i}" for i in range(8000))
    docs = frame(spark, [(1, words), (2, spans)])
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert tuple(got[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counted(words)
    found = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["base"]] for r in pii.personal_data(docs).collect()}
    assert found == {1: [], 2: base_spans(spans)}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}[2] == " ".join("[EMAIL] note: [PHONE]" for _ in range(8000))


def test_filter_over_quality_ends(spark):
    text = " ".join(f"w{i % 400}" for i in range(4000))
    assert quality.quality(frame(spark, [(1, text)])).where("kept").count() == 0


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "x://example.net/enx", "http://badexample.com/de/", "http://example.com/de", "http://a.b.example.com/de/?q=://z", "http://net/", "http://u.net", "http://x.org/fr/a#b", "http://ünï.org/fr/", "http://h?x=/", "://net/x", "a\nb://x.net/"]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice('abc')}{rng.randrange(9)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['de', 'en', 'fr'])}/{rng.randrange(999)}{rng.choice(['', '?a=1&b=2', '#t'])}" for _ in range(300)]
    rows = list(enumerate([*odd, *made]))
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for i, u in rows:
        host, path = place(u)
        rule = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == RULES[rule] if rule else got[i]["verdict"] in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(2)
    bad = [f"http://{rng.randrange(10**6)}-promo.example.net/{rng.randrange(10**6)}?a=1&b=2&c=3" for _ in range(150)]
    good = [f"https://www.example.org/fr/article-{rng.choice(['rouge', 'vert', 'bleu'])}" for _ in range(150)]
    unknown = [f"http://{rng.randrange(10**6)}-promo.example.info/{rng.randrange(10**6)}?a=1&b=2&c=3" for _ in range(40)] + ["https://www.example.info/fr/article-noir"] * 40
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(list(enumerate([*bad, *good, *unknown])), "page_id long, url string")).where("rule IS NULL").collect()}
    right = sum(v == ("block" if i < 340 else "allow") for i, v in got.items())
    assert len(got) == 80 and right >= 72
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert urls.filter_urls(spark.createDataFrame([(1, "http://a.de/")], "page_id long, url string")).first()["verdict"] == "allow"


def test_rates_leave_the_own_label_out(spark):
    labelled = [(f"http://h{i}.a.com/de/{i}", "a.com", float(i % 3 == 0)) for i in range(40)]
    df = spark.createDataFrame(labelled, "url string, host_tail string, label double")
    train, out = urls._with_rate(df, df.limit(1), df, "host_tail", "host_rate", 0.25, urls.UrlModel(smoothing=2.0))
    blocked = sum(x[2] for x in labelled)
    assert all(abs(r["host_rate"] - (blocked - r["label"] + 0.5) / 41) < 1e-12 for r in train.collect())
    assert abs(out.first()["host_rate"] - (blocked + 0.5) / 42) < 1e-12


def test_trees_judge_hosts_that_they_have_not_seen(spark, sf_dir):
    """Held-out accuracy: the verdicts of a fifth of the labelled hosts, learnt from the others."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = pages.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))}).withColumn("rule", urls.rule_of(F.col("host"), F.col("path")))
    labelled = rows.where("rule IS NOT NULL").withColumn("verdict", F.element_at(F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv)), F.col("rule")))
    if labelled.select("verdict").distinct().count() < 2:
        return
    held = F.pmod(F.xxhash64("host", F.lit(3)), F.lit(5)) == 0
    test = labelled.where(held)
    got = urls.judge(labelled.where(~held).select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label")), test.select("page_id", "url", "host", "path", "verdict"))
    right = got.agg(F.avg(((F.col("score") > 0.5) == (F.col("verdict") == "block")).cast("double"))).first()[0]
    base = test.agg(F.greatest(F.avg((F.col("verdict") == "block").cast("double")), F.avg((F.col("verdict") == "allow").cast("double")))).first()[0]
    assert right is None or right >= base - 0.05


def test_url_statistics_cover_all_labels(spark):
    rules = {"a.com/de/": "block", "org/fr/": "allow"}
    pages = [f"https://b.org/fr/{i:06}" for i in range(600)] + [f"https://a.com/de/{i:06}" for i in range(3)] + [f"https://a.com/en/{i:06}" for i in range(20)] + [f"https://c.org/en/{i:06}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    # three labels in 603 are likely in no sample of 20, but the rates and classes know them
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, urls.UrlModel(train_rows=20), rules).collect()}
    assert all(got[i] == (None, "block") for i in range(603, 623)) and all(got[i] == (None, "allow") for i in range(623, 643))


def dice(text):
    best = {}
    for unit in {*text.split("\n"), *re.split(r"\n[ \t]*\n", text), text}:
        g = set(licenses.bigrams(unit))
        for name, texts in licenses.TEMPLATES.items():
            for t in map(set, map(licenses.bigrams, texts)):
                d = 2_000_000 * len(g & t) // (len(g) + len(t))
                if d >= 800_000:
                    best[name] = max(best.get(name, 0), d)
    return sorted(((n, d) for n, d in best.items()), key=lambda x: (-x[1], x[0]))


def test_licences_equal_brute_force(spark):
    some = [t for texts in licenses.TEMPLATES.values() for t in texts]
    rows = [*some, "\n".join(some), "\n\n".join(some[:4]), some[2].replace("Software", "Program"), some[2].replace(" to any", "\nto any"), "// " + some[0].upper(), "plain words", "MIT", *(t or "" for _, t in corpus(11)[:10])]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: [(x["name"], x["dice_ppm"]) for x in r["licenses"]] for r in licenses.scan_licenses(frame(spark, [*rows, (900, None)])).collect()}
    # near templates (the GNU family) come closer in a window than in the whole notice
    both = lambda t: {n: max(dict(dice(t)).get(n, 0), d) for n, d in {**dict(dice(t)), **(windows(t) if len(t) < 3000 else {})}.items()}
    assert got == {**{i: sorted(both(t).items(), key=lambda x: (-x[1], x[0])) for i, t in rows}, 900: []}
    assert got[0][0][1] == 1_000_000


def test_anchor_words_are_in_every_match():
    words = set(licenses.anchors(licenses.TEMPLATES, 80))
    for texts in licenses.TEMPLATES.values():
        for b in map(licenses.bigrams, texts):
            least = -(-80 * len(b) // 120)
            missing = [x for x in b if not words & set(x.split())]
            assert len(missing) < least  # bigrams without an anchor are too few for a match


def test_licences_of_odd_tables(spark, tmp_path):
    assert licenses.scan_licenses(frame(spark, [])).collect() == []
    notice = licenses.TEMPLATES["ISC"][0]
    rows = [(1, None), (1, None), (None, notice), (2, prose(random.Random(1), 200_000, 10**6) + f"\n{notice}\n")]
    frame(spark, rows).withColumnRenamed("lang", "_units").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["license"], r["n_licenses"]) for r in licenses.op6_license_scan(spark, str(tmp_path)).collect())
    assert got == [(0, "ISC", 1), (1, None, 0), (1, None, 0), (2, "ISC", 1)]


def windows(text):
    """Best Dice of any run of bigrams with a template, by trying all of the sizes in reach."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    best = {}
    for name, texts in licenses.TEMPLATES.items():
        for t in map(set, map(licenses.bigrams, texts)):
            for a in range(len(grams)):
                for b in range(a + 1, min(len(grams), a + len(t) * 120 // 80) + 1):
                    g = set(grams[a:b])
                    d = 2_000_000 * len(g & t) // (len(g) + len(t))
                    if d >= 800_000:
                        best[name] = max(best.get(name, 0), d)
    return best


def test_embedded_and_wrapped_notices_are_found(spark):
    rng = random.Random(14)
    mit, apache, bsd = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][1], licenses.TEMPLATES["BSD"][0]
    wrap = lambda text, lead: "\n".join(lead + " ".join(text.split()[i : i + 5]) for i in range(0, len(text.split()), 5))
    prose_ = lambda: prose(rng, 40)
    rows = [
        f"{prose_()}. Released under the MIT License. {prose_()}",
        f"{prose_()}\n{wrap(mit, '')}\n{prose_()}",
        f"# {prose_()}\n#\n{wrap(apache, '# ')}\n#\n# {prose_()}",
        f" * {prose_()}\n *\n{wrap(bsd.replace('binary', 'object'), ' * ')}\n * {prose_()}",
        "\r\n\r\n".join([prose_(), wrap(apache, "").replace("\n", "\r\n"), prose_()]),
        f"{prose_()} licensed under the terms of the software and of the license {prose_()}",
    ]
    got = {r["doc_id"]: {x["name"]: x["dice_ppm"] for x in r["licenses"]} for r in licenses.scan_licenses(frame(spark, list(enumerate(rows)))).collect()}
    assert got == {i: {**dict(dice(t)), **windows(t)} for i, t in enumerate(rows)}
    assert [sorted(got[i]) for i in range(6)] == [["MIT"], ["MIT"], ["Apache-2.0"], ["BSD"], ["Apache-2.0"], []] and not any(dice(t) for t in rows)


@pytest.mark.parametrize("column", ["verdict", "kept"])
def test_results_can_be_counted(spark, column):
    df = urls.filter_urls(spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")) if column == "verdict" else quality.quality(frame(spark, [(1, "a b")]))
    assert df.groupBy(column).agg(F.count("*")).count() == 1


def test_license_windows_in_dense_and_repeated_notices(spark):
    """Notices one after the other, cut, shuffled and with other words between: windows equal all windows tried out."""
    rng = random.Random(31)
    some = [licenses.TEMPLATES["Apache-2.0"][1], licenses.TEMPLATES["ISC"][0], licenses.TEMPLATES["Zlib"][0], licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["AGPL-3.0"][0]]
    rows = [" ".join([some[0]] * 4), f"{some[1]} x y z {some[1]}", f"{some[3]} {some[4]}"]
    for _ in range(12):
        words = " ".join(rng.choice(some) for _ in range(2)).split()
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(0, 3)] = rng.choice([[], ["other"], words[:3], ["the", "software"]])
        rows.append(" ".join(words))
    got = {r["doc_id"]: {x["name"]: x["dice_ppm"] for x in r["licenses"]} for r in licenses.scan_licenses(frame(spark, list(enumerate(rows)))).collect()}
    whole = lambda t: {n: max(dict(dice(t)).get(n, 0), windows(t).get(n, 0)) for n in {**dict(dice(t)), **windows(t)}}
    assert got == {i: whole(t) for i, t in enumerate(rows)}


def test_a_file_full_of_notices(spark):
    """Half a million characters of notices, with and without changes, in one text."""
    mit = licenses.TEMPLATES["MIT"][3]
    changed = " ".join(w if i % 12 else f"zz{i}" for i, w in enumerate(mit.split()))
    big = [(1, f"code here\n{mit} more\n" * 300), (2, f"code {changed} more " * 300)]
    small = [(3, f"code here\n{mit} more\n" * 2), (4, f"code {changed} more " * 2)]
    got = {r["doc_id"]: {x["name"]: x["dice_ppm"] for x in r["licenses"]} for r in licenses.scan_licenses(frame(spark, big + small)).collect()}
    assert got[1]["MIT"] == 1_000_000 and got[2] == got[4] and 800_000 <= got[2]["MIT"] < 1_000_000


def test_bootstrapping_goes_on_until_nothing_new_is_found(spark):
    """Labels that only share values with the one before them: more rounds than any fixed small number, to where the scores stand."""
    rng = random.Random(41)
    line = lambda label, value: f"{prose(rng, 9)} {label}: {value} {prose(rng, 6)}"
    held = {"labela": [f"user{j}@mail.example" for j in range(60)] + [f"id0x{j}y" for j in range(3)]}
    held |= {f"label{c}": [f"id{i + n}x{j}y" for n in range(2) for j in range(3)] for i, c in enumerate("bcdefgh")}
    rows = [(label, line(label, v)) for label, values in held.items() for v in values]
    for limit in (0.05, 0.6):
        confident: dict[str, float] = {}
        for _ in range(200):  # by force: far more rounds than it takes
            scores = {v: 1.0 for v in held["labela"] if "@" in v}
            for label, c in confident.items():
                scores |= {v: max(c, scores.get(v, 0)) for v in held[label] if "@" not in v}
            now = {label: [scores[v] for v in values if v in scores] for label, values in held.items()}
            confident = {label: min(1.0, sum(x) / (len(held[label]) + 0.5)) for label, x in now.items() if len(x) >= 3}
            confident = {label: c for label, c in confident.items() if c >= limit}
        found = pii.personal_data(frame(spark, [(i, t) for i, (_, t) in enumerate(rows)]), pii.Bootstrap(confidence=limit)).collect()
        marked = {r["doc_id"] for r in found if len(r["spans"]) > len(r["base"])}
        assert marked == {i for i, (label, t) in enumerate(rows) if "@" not in t and label in confident}
        assert ("labelh" in confident) == (limit == 0.05)
