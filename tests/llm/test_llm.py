"""The training-data operators on small fixtures, against brute force."""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutline.llm import decontaminate, graph, html, kernels, licences, lines, ngram_join, packing, quotes, toxicity, urls, vectors

DOCS = "doc_id long, text string, n_shingles string"


def words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"wort{v}" for v in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def texts():
    base = words(60, 1)
    near = base[:30] + ["andere"] + base[31:]
    out = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(near)), (4, " ".join(words(60, 2)))]
    out += [(5, None), (6, ""), (7, " \t\n"), (8, "zwei worte"), (9, "Zwei  worte"), (10, "x " * 30_000), (4, " ".join(words(60, 2)))]
    return out + [(20 + i, " ".join(base[:25] + words(40, 100 + i))) for i in range(12)]


def brute(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {(d, len(s), group[d]) for d, s in sets.items()}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, texts, size, percent):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in texts], DOCS)
    got = [tuple(r) for r in ngram_join.near_copies(docs, size, percent).collect()]
    assert len(got) == len(texts)
    assert set(got) == brute(texts, size, percent)


def test_ngram_join_empty(spark):
    assert ngram_join.near_copies(spark.createDataFrame([], DOCS)).count() == 0
    alone = ngram_join.near_copies(spark.createDataFrame([(None, "a b c", "x")], DOCS)).collect()
    assert [tuple(r) for r in alone] == [(None, 1, None)]


def test_line_dedup(spark):
    long = " ".join(words(80, 5))
    edited = long.replace(long.split()[40], "geaendert", 1)
    rows = [
        (1, f"{long}\nkurz\n\nallein eins", "a"), (2, f"neu\n{edited}\n\nKURZ", "b"), (3, None, "c"), (4, "", "d"),
        (5, long, "e"), (None, long, "f"), (6, " ".join(words(80, 6)), "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "neu\n", 3: None, 4: "", 5: "", None: long, 6: rows[6][1]}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_reads_whole_lines(spark):
    cjk = "".join(chr(0x4E00 + 7 * i) for i in range(24))
    kept = [
        "https://www.example.com/en/page1?id=77", "https://www.example.com/fr/other/thing", cjk + "".join(map(chr, range(0x5E00, 0x5E20))),
        cjk + "".join(map(chr, range(0x6E00, 0x6E20))), "abcdefghijklmnopqrstuvwx a b c d e f g h", "abcdefghijklmnopqrstuvwx 1 2 3 4 5 6 7 8",
    ]
    rows = [(i, line) for i, line in enumerate(kept)] + [(20, kept[0] + "8"), (21, kept[2] + "x")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(kept)) | {20: "", 21: ""}


def test_line_dedup_recall(spark):
    """One-character and one-word edits of short lines, against brute force over all five-character shingles."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def word():
        return "".join(rng.choice(letters, rng.integers(2, 11)))

    rows, near = [], {}
    for i in range(300):
        line = word()
        while len(line) < 40 + i * 210 // 300:
            line += " " + word()
        at = int(rng.integers(0, len(line)))
        parts = line.split(" ")
        parts[rng.integers(0, len(parts))] = word()
        rows.append((i, line))
        for k, edit in ((1000 + i, line[:at] + "#" + line[at + 1 :]), (2000 + i, " ".join(parts))):
            a, b = ({t[j : j + 5] for j in range(len(t) - 4)} for t in (line, edit))
            rows.append((k, edit))
            near[k] = 100 * len(a & b) >= 80 * len(a | b)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = [k for k, linked in near.items() if linked]
    assert len(true) > 400 and sum(got[k] for k in true) >= 0.98 * len(true)
    # An edit of a far edit's line may meet its other edit; no line without a near one is lost.
    assert not any(got[i] for i in range(300))


def test_line_sets_equal_brute_force():
    """Sets, sizes and common shingles of odd texts, alone and in runs, in steps smaller than a text."""
    plain = ["a", "abcd", "abcde", "abcdeabcde", "日本語の長い行です。日本語", "é" * 9, "\U0001f600ab\U0001f600cd", "x" * 3000, "abcdX", "日本"]
    sets = [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in plain]
    column = pa.array(plain * 900)
    runs = list(lines._runs(column))
    assert [r[0] for r in runs][0] == 0 and runs[-1][1] == len(column) and max(b - a for a, b, _ in runs) <= lines._RUN
    sizes = np.concatenate([np.bincount((k >> np.uint64(51)).astype(int), minlength=b - a) for a, b, k in runs])
    assert sizes.tolist() == [len(s) for s in sets] * 900
    pairs = [(i, j) for i in range(len(plain)) for j in range(len(plain))]
    batch = pa.RecordBatch.from_pydict(
        {"a": [i for i, _ in pairs], "b": [j for _, j in pairs], "p": [plain[i] for i, _ in pairs], "q": [plain[j] for _, j in pairs]}
    )
    for percent in (1, 50, 80):
        got = [(r["a"], r["b"]) for out in lines._verifying(percent)([batch]) for r in out.to_pylist()]
        assert got == [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def test_line_bitmaps_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcé日"), rng.integers(1, 400))) for _ in range(60)] + ["a", "abcde"]
    sets = [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in plain]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(plain))), "plain": plain})
    marks = [r for out in lines._marks([batch]) for r in out.to_pylist()]
    assert [(r["id"], r["plain"]) for r in marks] == list(enumerate(plain))
    for i, p in enumerate(marks):
        for j, q in enumerate(marks):
            differ = sum(((p[f"bits{w}"] ^ q[f"bits{w}"]) & (1 << 64) - 1).bit_count() for w in range(lines.WORDS))
            assert differ <= len(sets[i] ^ sets[j]) and differ % 2 == len(sets[i] ^ sets[j]) % 2


def test_line_dedup_makes_few_pairs_of_a_group_without_links(spark, monkeypatch):
    """Copies of one line with four edits each share bands and link with none: 7,140 pairs that are no result."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    base = rng.choice(letters, 254)

    def edited(at):
        out = base.copy()
        out[at] = "#"
        for k in at:
            out[k] = chr(0x100 + int(rng.integers(0, 5000)))
        return "".join(out)

    rows = [(i, edited(rng.choice(25, 4, replace=False) * 10 + rng.integers(0, 10, 4))) for i in range(120)]
    sets = [{t[j : j + 5] for j in range(len(t) - 4)} for _, t in rows]
    near = {b for b in range(120) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rows += [(1000 + i, t + "!") for i, t in rows[:10]]
    made = {}

    def counted(frame, name, stored=graph.stored):
        out = stored(frame, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(graph, "stored", counted)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i] for i in range(120) if i not in near) and all(got[1000 + i] for i in range(10))
    assert made["stars"] + made["apart"] < 1000


def test_line_sets_of_a_long_line(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcé"), 20_000))
    whole = lines._sets(*texts_of([text]))
    monkeypatch.setattr(lines, "_STEP", 777)
    assert np.array_equal(whole, lines._sets(*texts_of([text])))
    assert len(whole) == len({text[i : i + 5] for i in range(len(text) - 4)})


def texts_of(rows):
    return kernels.texts(pa.array(rows))


def test_line_dedup_keeps_clashing_names(spark):
    rows = [(1, "eine Zeile, die zweimal steht", "x", 5, "n"), (2, "eine Zeile, die zweimal steht", None, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, rows int, h1 string")
    got = sorted(tuple(r) for r in lines.dedup_lines(docs).select("doc_id", "text", "gone", "rows", "h1", "n_dropped").collect())
    assert got == [(1, rows[0][1], "x", 5, "n", 0), (2, "", None, None, "m", 1)]


def test_quote_linking_is_native(spark, capsys):
    quotes.link_quotes(spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn long, role string, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_packing_round_trip(spark, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(900, "a<|endoftext|>b é 語"), (901, "don't  stop\n\n 12345")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=128).collect()
    ids = {d: [*exact.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    for doc, own in ids.items():
        pieces = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert sum(r["length"] for r in pieces) == len(own) and all(r["length"] == 128 for r in pieces[1:])
        for r in pieces:
            part = own[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_configurations_hold_every_piece():
    rng = np.random.default_rng(3)
    histogram = Counter(rng.integers(1, 101, 5000).tolist())
    plan = packing.solve(dict(histogram), 100)
    held = Counter()
    for times, config in plan:
        assert sum(n * k for n, k in config.items()) <= 100
        for n, k in config.items():
            held[n] += times * k
    assert held == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(t for t, _ in plan) <= 1.01 * -(-total // 100)
    assert packing.solve({}, 100) == []


def distance(window, text):
    """Least edits of window against any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    item = " ".join(words(30, 8, 5000))
    swapped = item.split()
    swapped[4], swapped[20] = "anderes", "nochwas"
    rows = [
        (1, "vorher " + item + " nachher"), (2, "Und: " + " ".join(swapped).upper() + "!"), (3, " ".join(words(300, 9, 5000))),
        (4, None), (5, ""), (6, item[:50]), (7, " ".join(words(9000, 10, 5000)) + " " + item),
    ]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "kurz")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1), (2, 1), (7, 1)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [80, 95, 110, 135])
def test_decontamination_finds_excerpts(size):
    """Verbatim excerpts from any place, and none in texts of the same words in another order."""
    items = [(i, " ".join(words(60, 70 + i, 5000))) for i in range(6)]
    index = decontaminate.Index(items)
    for i, text in items:
        for at in range(0, len(text) - size, 13):
            raw = decontaminate.plain("vorher hier " + text[at : at + size] + " nachher dort")
            assert [index.ids[f[0]] for f in index.search(raw)] == [i], (i, at)
        mixed = " ".join(np.random.default_rng(i).permutation(text.split()))
        assert index.search(decontaminate.plain(mixed)) == []


def test_decontamination_of_odd_rows(spark):
    item = " ".join(words(30, 8, 5000))
    rows = [(None, item), (None, "sauber"), (1, item), (1, "sauber"), (2, "Ein  kurzer Satz!"), (3, "kein kurzer Satzbau"), (4, "ab " * 9000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, "kurzer satz"), (3, "ab " * 200 + "ende")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {(None, "sauber"), (1, "sauber"), (3, "kein kurzer Satzbau")}


def test_decontamination_in_small_stretches(monkeypatch):
    """The windows found do not depend on how many shared q-grams are held at once."""
    items = [(1, " ".join(words(40, 5, 30))), (2, "ab " * 60 + "cd " * 30), (3, "kurz")]
    raw = decontaminate.plain(" ".join([" ".join(words(500, 6, 30)), items[0][1], "ab " * 90, "kurz", items[1][1]]))
    whole = decontaminate.Index(items).search(raw)
    monkeypatch.setattr(decontaminate, "PAIRS", 500)
    assert [(f[0], f[4]) for f in decontaminate.Index(items).search(raw)] == [(f[0], f[4]) for f in whole]
    assert {f[0] for f in whole} == {0, 1, 2}


def test_alignment_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        window = bytes(rng.integers(97, 101, 30).astype(np.uint8))
        copy = bytearray(window)
        for _ in range(rng.integers(0, 5)):
            copy[rng.integers(0, len(copy))] = rng.integers(97, 101)
        if rng.random() < 0.5:
            del copy[5]
        raw = b"zzzz" + bytes(copy) + b"yyyy"
        found = decontaminate.align(window, raw, 0, len(raw), 3)
        least = distance(window, raw)
        assert (found is not None and found[2] == least) if least <= 3 else found is None


def test_licences(spark):
    rows = [
        (1, "Licensed under CC BY 4.0. cc by", "x"), (2, "All Rights Reserved. all rights reserved", "x"),
        (3, "Licensed under the Apache License, Version 2.0", "x"), (4, None, "x"), (5, "no licence here: general public", "x"),
        (6, "under the GNU General Public License, version 3", "x"), (7, "accby cc byé", "x"),
    ]
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert [got[i]["n_base"] for i in range(1, 8)] == [2, 2, 0, 0, 0, 1, 0]
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (8, 2, 6, "cc-by")
    assert got[3]["labels"] == "apache-2.0" and got[6]["labels"].startswith("gpl") and got[4]["labels"] == ""
    assert got[4]["first_word"] is None and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity(spark):
    plain = [" ".join(words(40, i)) for i in range(120)]
    rows = [(i, t + (" garstig" if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(plain)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(labelled.unionByName(labelled.select("doc_id", "text", F.lit(None).cast("int").alias("toxic"))))
    assert " garstig " in model.weights
    tried = [(1, "ein G4rst1g mensch"), (2, "ein gаrstig mensch"), (3, "ein netter mensch"), (4, None), (5, ""), (6, "you IDI0T")]
    frame = spark.createDataFrame(tried, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert min(got[1], got[2]) > 0.5 > max(got[3], got[4], got[5]) and got[6] > got[3]
    assert {r["doc_id"] for r in toxicity.reject(frame, model).collect()} >= {3, 4, 5}
    assert toxicity.learn(labelled.limit(0)).weights
    # A sign is a letter before or between letters, and punctuation at a word's end.
    assert toxicity.fold("Ünd ₣oo—B@r$!") == " ünd oo bar "


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Top</header>"
        "<div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text<br>more<p>Two &lt;x&gt;"
        "<div class=\"comments\">nice!</div><script>var a='</p>';</script><p>Three</article><footer>&copy; me</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>cut &am"), (5, "u", "just text"), (5, "u", "just text")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html.extract(frame).orderBy("page_id").collect()]
    assert got[0] == (1, "Head & line\n\nOne bold text more\n\nTwo <x>\n\nThree")
    assert got[1:] == [(2, ""), (3, ""), (4, "cut &am"), (5, "just text"), (5, "just text")]


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    x = np.vstack([base, base[:20] + 0.2 * rng.normal(size=(20, 64)), base[:5], 3 * base[:5]]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 64, 0), (202, [float("nan")] + [1.0] * 63, 0), (203, [], 0), (None, [1.0] * 64, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    true = near.sum(1)
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.9 * true.sum()
    assert all(got[i]["n_links"] <= true[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (200, 201, 202, 203))
    assert len(got) == len(rows) and not got[None]["kept"]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "amid",
    [
        '<div class="ad"><p>x</p></div>', "<aside><p>y</p><p>z</p></aside>", '<div class="promo"><p>a</p><p>b</p><p>c</p></div>' * 3,
        '<div class="related"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div>',
    ],
)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_main_text_goes_on_after_noise(amid, around):
    page = f"<body><nav><ul><li><a>Menu</a><li><a>More</a></ul></nav><{around}><p>{'a' * 900}<p>{'b' * 800}{amid}<p>{'c' * 700}<p>{'d' * 600}</{around}></body>"
    assert html.main_text(page) == "\n\n".join(["a" * 900, "b" * 800, "c" * 700, "d" * 600])


def test_main_text_keeps_link_lists_parted_text():
    links = "<ul>" + "".join(f"<li><a href={i}>Item {i}</a></li>" for i in range(5)) + "</ul>"
    assert html.main_text(f"<article><p>{'a' * 90}</p>{links}<nav><p>x</p><p>y</p></nav><p>{'b' * 70}</p></article>") == "a" * 90 + "\n\n" + "b" * 70


def test_main_text_keeps_paragraphs_that_are_links():
    link = "Read the full report of the committee"
    assert html.main_text(f"<article><p>{'a' * 90}</p><p><a href=r>{link}</a></p></article>") == "a" * 90 + "\n\n" + link
    assert html.main_text(f"<div><p>{'a' * 90}</p><p><a href=r>{link}</a></p></div>") == "a" * 90


@pytest.mark.parametrize("anchor", ["<a name=top>", "<a id='x'>Mark", "<a href=y>Cut"])
def test_main_text_after_unclosed_anchors(anchor):
    page = f"<body><p>{anchor}</p><p>{'a' * 90}</p><p>{'b' * 90} <a href=z>c</a></p></body>"
    assert html.main_text(page).endswith("a" * 90 + "\n\n" + "b" * 90 + " c")


@pytest.mark.parametrize("holder", ["body", "div", "td"])
@pytest.mark.parametrize("row", ["<nav><p>x</p><p>y</p></nav>", "<p><a href=1>More of this</a></p>"])
def test_main_text_goes_on_after_rows_of_noise(holder, row):
    page = f"<{holder}><p>{'a' * 300}</p>{row * 4}<section><p>{'b' * 200}</p></section></{holder}><div><p>c</p></div>"
    assert html.main_text(page).startswith("a" * 300 + "\n\n" + "b" * 200)


def test_main_text_of_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert html.main_text(deep) == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {i} <b>and more</b></p>" for i in range(20_000)) + "</article>"
    assert html.main_text(long).count("\n\n") == 19_999


@pytest.mark.parametrize("name", ["has-sidebar", "social-history", "layout no-widget"])
def test_main_text_inside_a_wrapper_named_like_noise(name):
    assert html.main_text(f"<body><div class='{name}'><p>First part</p><p>Second part</p></div></body>") == "First part\n\nSecond part"
    named = f"<div id='{name}'><main><p>Text</p><div class='ad'>Buy</div><p>Rest</p></main></div><p>x</p>"
    assert html.main_text(named).startswith("Text\n\nRest")


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000, 3_000_000])
def test_vector_tables_meet_the_threshold_at_every_size(spark, n):
    """Pairs at cosine 0.9 exactly, searched with the tables that ``n`` vectors get."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * side / np.linalg.norm(side, axis=1, keepdims=True)
    model = vectors.rotation(np.vstack([x, y]), 64)
    turns, tables, width, radius = vectors.tabled(x, model, 0.9, n)
    place = np.uint64(1) << np.arange(64, dtype=np.uint64)
    codes = [((((np.vstack([x, y]) - model[0]) @ t >= 0) * place).sum(1, dtype=np.uint64)).view(np.int64) for t in turns]
    names = [f"code{k}" for k in range(len(turns))]
    frame = spark.createDataFrame([(i, *[int(c[i]) for c in codes]) for i in range(1200)], ", ".join(["id long", *[f"{c} long" for c in names]]))
    found = [tuple(r) for r in vectors._pairs(frame, 64, tables, width, radius).collect()]
    assert len(found) == len(set(found))
    assert sum((i, 600 + i) in set(found) for i in range(600)) >= 0.9 * 600


def test_urls(spark):
    rows = [
        (1, "https://www.EXAMPLE.com/en/1"), (2, "http://x.example.com/en/2?q=1"), (3, "http://a.net/es/3"), (4, "ftp://b.com"),
        (5, None), (6, "no scheme"), (7, "http://a.com/x#y"), (8, "http://com/"), (9, "http://notnet/es/"),
    ]
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4][:3] == ("b.com", "", None) and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None)
    assert got[7] == ("a.com", "/x", "com/", "allow") and got[8][2:] == ("com/", "allow") and got[9][2] is None
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("dims,rank,common", [(64, 64, 1.0), (256, 32, 0.0), (768, 32, 0.0), (768, 64, 1.0), (768, 64, 2.0)])
@pytest.mark.parametrize("n", [50_000, 1_000_000])
def test_vector_tables_in_a_subspace(dims, rank, common, n):
    """Pairs at the threshold between vectors of one subspace, with a common component."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8000, rank)) @ rng.normal(size=(rank, dims)) / np.sqrt(rank)
    base += 0.02 * rng.normal(size=base.shape) + common * rng.normal(size=dims)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    fit, x, other = base[:6000], base[6000:7000], base[7000:]
    model = vectors.rotation(fit, 64)
    turns, tables, width, radius = vectors.tabled(fit, model, 0.9, n)
    side = other - (x * other).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * side / np.linalg.norm(side, axis=1, keepdims=True)
    chunks, met = 64 // width, np.zeros(len(x), bool)
    apart = [((x - model[0]) @ t >= 0) != ((y - model[0]) @ t >= 0) for t in turns]
    for t in range(tables):
        met |= apart[t // chunks][:, t % chunks * width : (t % chunks + 1) * width].sum(1) <= 1
    assert (met & (apart[0].sum(1) <= radius)).mean() >= 0.9 and tables <= max(chunks, vectors.TABLES)


def test_vector_components_against_brute_force(spark, sf_dir):
    """Links, components and kept rows of the registered query over the smallest given table."""
    from cutline.llm import catalog

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    own = [r for r in rows if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    u = np.array([r["embedding"] for r in own], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    group = np.array([r["vec_id"] for r in own])
    while True:
        after = np.array([min(group[i], group[near[i]].min(initial=group[i])) for i in range(len(u))])
        if (after == group).all():
            break
        group = after
    got = {r["vec_id"]: r for r in catalog.queries()["op9_near_vectors"](spark, sf_dir).collect()}
    links = np.array([got[r["vec_id"]]["n_links"] for r in own])
    assert len(got) == len(rows) and (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    same = np.array([got[r["vec_id"]]["component_id"] for r in own]) == group
    assert same.mean() >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def _rules_by_counting(rows, support, confidence):
    """Every token set of the labelled rows that says its label, without those a part of them already says."""
    sets, both = Counter(), Counter()
    for items, label in rows:
        for mask in range(1, 1 << len(items)):
            part = frozenset(x for i, x in enumerate(items) if mask >> i & 1)
            sets[part] += 1
            both[part, label] += 1
    rules = {k: n / sets[k[0]] for k, n in both.items() if n >= support * len(rows) and n >= confidence * sets[k[0]]}
    return {k: c for k, c in rules.items() if not any(p < k[0] and v == k[1] and d >= c for (p, v), d in rules.items())}


def test_mined_rules_against_counting(spark):
    rng = np.random.default_rng(12)
    rows = [([f"t{i}" for i in range(6) if rng.random() < 0.6], str(rng.choice(["block", "allow"], p=[0.8, 0.2]))) for _ in range(80)]
    rows = [(i, v) for i, v in rows if i]
    got = urls.mine(spark.createDataFrame(rows, "items array<string>, label string"), 0.1, 0.8).collect()
    true = _rules_by_counting(rows, 0.1, 0.8)
    assert {(frozenset(r["items"]), r["label"]) for r in got} == set(true)
    assert all(abs(r["confidence"] - true[frozenset(r["items"]), r["label"]]) < 1e-9 for r in got)


def test_urls_with_many_shared_names(spark):
    """Parameters and path parts that many urls share do not multiply the item sets."""
    names = "&".join(f"p{k}=1" for k in range(60))
    deep = "/".join(f"s{k}" for k in range(40))
    rows = [(i, f"https://a.example.com/en/{deep}/{i}?{names}") for i in range(400)] + [(1000 + i, f"http://b.org/{deep}/{i}?{names}") for i in range(30)]
    got = urls.judge(spark.createDataFrame(rows + rows[:5], "page_id long, url string")).collect()
    assert len(got) == 435 and {r["verdict"] for r in got} == {"block"}
    assert {r["decided_by"] for r in got if r["page_id"] >= 1000} == {"mined"}
    sizes = spark.createDataFrame(rows, "page_id long, url string").select("url", *[c.alias(n) for c, n in zip(urls.host_and_path(F.col("url")), ("host", "path"))])
    assert sizes.select(F.max(F.size(urls.tokens()))).first()[0] <= 8


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> hello  THERE\n> second line\nMy answer"),
        (1, 2, "u", ">> hello there\n> My answer\nthanks"), (2, 0, "u", "> my answer\nfrom abroad"), (2, 1, "a", None),
        (2, 2, "a", ""), (None, 3, "a", "lost"), (3, 0, "u", "> unknown words"),
    ]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(rows)
    assert got[1, 1]["body"] == "My answer" and got[1, 1]["parent_turn"] == 0
    assert (got[1, 2]["parent_turn"], got[1, 2]["thread_turn"], got[1, 2]["depth"], got[1, 2]["max_level"]) == (1, 0, 2, 2)
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_turn"]) == (1, 1)
    assert got[3, 0]["parent_turn"] is None and got[3, 0]["n_quotes"] == 1 and got[2, 1]["body"] == ""


def test_quotes_of_later_lines_and_other_conversations(spark):
    rows = [
        (1, 0, "u", "opening words here\nthe second paragraph"), (1, 1, "a", "> words here\n> the second paragraph\nyes"),
        (2, 0, "u", "> shared sentence\nno"), (2, 1, "a", "shared sentence"), (3, 0, "u", "shared sentence"), (4, 0, "u", "shared sentence"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1]["parent_conv"], got[1, 1]["parent_turn"]) == (1, 0)
    assert (got[2, 0]["parent_conv"], got[2, 0]["parent_turn"]) == (3, 0)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf_dir).persist())
        assert steps[-1].columns == docs.columns
        assert 0 < steps[-1].count() <= steps[-2].count()
    groups = ngram_join.near_copies(steps[3]).where("n_shingles > 0")
    assert groups.count() == groups.select("component_id").distinct().count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contaminated(steps[4], bench).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[4], sf_dir)
    assert packed.select("doc_id").distinct().count() == steps[4].count()
    for step in steps[1:]:
        step.unpersist()


def test_seeds_yield_to_labels(spark):
    rows = [(i, f"the clown came {i} times, word{i % 7}", 0) for i in range(300)] + [(1000 + i, f"you vermin {i}, word{i % 7}", 1) for i in range(100)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert " clown " not in model.weights and " vermin " in model.weights and " idiot " in model.weights
    docs = spark.createDataFrame([(1, "a clown"), (2, "you vermin"), (3, "an idiot")], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [False, True, True]


def test_folding_looks_up_no_letter_one_by_one():
    """The words of a folding letter by letter, in less time than one look-up of each letter takes."""
    table = toxicity._LOOKALIKES | {chr(c): b or "" for c, b in toxicity._TABLE.items()}

    def plain(text):
        text = "".join(table.get(c, c) for c in text.lower())
        text = toxicity._SIGN.sub(lambda m: "".join(toxicity._SIGNS[c] for c in m[0]), text)
        words = "".join(toxicity._DIGITS.get(c, c if c.isalnum() else " ") for c in text).split()
        return f" {' '.join(words)} " if words else " "

    rng = np.random.default_rng(2)
    odd = [*"aZ09 _@$!|-.\u00a0\u200b\u00ad\u0301\u0130\uff21ßéΣа语🙂½٣", *map(chr, range(0x2010, 0x2030)), "\ud800"]
    for n in range(400):
        text = "".join(rng.choice(odd, n % 40))
        assert toxicity.fold(text) == plain(text), ascii(text)
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("…") == " "
    text = "größere Wörter für день, naïve Leute – " * 20_000
    look_up = {ord(a): b for a, b in table.items()}

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: toxicity.fold(text)) < seconds(lambda: text.translate(look_up))


def test_ngram_join_frees_shuffle_files(spark, texts, monkeypatch):
    """Each written table takes its shuffle files with it, and the setting is as before afterwards."""
    name, seen, connect = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], ngram_join.connect
    monkeypatch.setattr(ngram_join, "connect", lambda *args: seen.append(spark.conf.get(name, "false")) or connect(*args))
    before = spark.conf.get(name, "false")
    docs = spark.createDataFrame(texts[:6], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_copies(docs).collect()} == brute(texts[:6], 5, 80)
    assert (seen, spark.conf.get(name, "false")) == (["true"], before)


def test_lines_are_made_plain_once(spark):
    odd = ["", " ", "  ", "\t", " \t \r\f\v ", "\u00a0", "\u0085", "\u2003", "\u001c", "a", " A  b ", "\tİ", None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, raw string")
    got = frame.select("raw", lines._blank(F.col("raw")).alias("blank"), (lines._plain(F.col("raw")) == "").alias("want"))
    for row in got.collect():
        assert row["blank"] == row["want"], row
    left = frame.where(~lines._blank(F.col("raw"))).select(lines._plain(F.col("raw")).alias("plain"))
    assert left._jdf.queryExecution().executedPlan().toString().count("lower(") == 1


def test_training_rows_of_toxicity(spark):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)] + [(3, False), (None, True)], "doc_id long, t boolean").selectExpr("doc_id", "cast(t as int) toxic")
    docs = spark.createDataFrame([(i, f"text {i}", "clash") for i in range(200)], "doc_id long, text string, toxic string")
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.training_rows(docs, labels).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(200) if i not in held}
    assert toxicity.training_rows(docs, labels, rows=50).count() == 50
