"""Leaks, mixtures and wrong encodings."""

import difflib
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm.catalogue import QUERIES
from millrace.llm.encoding import Cipher, Cutter, code_pages, decode, find_garbled
from millrace.llm import leaks
from millrace.llm.leaks import ItemIndex, find_leaks
from millrace.llm.mixture import mix_sources, sainte_lague
from millrace.llm.words import word_numbers


@pytest.fixture(scope="module")
def items(sf):
    t = pq.read_table(f"{sf}/eval_items.parquet").to_pydict()
    return dict(zip(t["item_id"], t["text"]))


def numbers(text):
    return word_numbers(pa.array([text]))[0].tolist()


def test_word_numbers_survive_damage():
    whole = numbers("Déjà l’été, the mortgage of Ostquo: 3,654 crowns")
    assert len(whole) == 9
    assert numbers("DEJA l’ete the mort-\ngage OF ostquo 3 654 crowns") == whole
    assert numbers("Déjà l’été, the mortgage of Ostquo: 3,654 crowns".encode().decode("latin-1")) == whole
    assert numbers("D&eacute;j&agrave; l’&eacute;t&eacute; the mortgage of 0stquo: 3,654 crowns") == whole
    assert numbers("") == [] and numbers("é à …") == [] and len(numbers("x " * 50_000)) == 50_000
    n, text, _ = word_numbers(pa.array(["one two", None, "", "two"]))
    assert text.tolist() == [0, 0, 3] and n[1] == n[2]


def leak_found(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    its = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r["item_id"], r["doc_id"]) for r in find_leaks(docs, its, **how).collect()}


def test_leaks(spark, items):
    rng = random.Random(1)
    ids = sorted(items)[:30]
    texts, want = [], set()
    filler = "Nothing here is of any interest to anybody who reads these lines of filler about the weather. "
    for k, i in enumerate(ids):
        w = items[i].split()
        if len(w) < 40:
            continue
        part = w[5:36]
        how = k % 6
        if how == 1:
            for at in rng.sample(range(1, 30), 3):
                part[at] = "altered"
        elif how == 2:
            del part[9], part[20]
        elif how == 3:
            part[15:15] = ["-", "2", "-"]
        elif how == 4:
            part = [x.upper() for x in part]
        elif how == 5:
            part = part[:14]  # too short
        texts.append(filler * 2 + " ".join(part) + "\n" + filler)
        if how != 5:
            want.add((i, len(texts) - 1))
    damaged = items[ids[0]].encode().decode("cp1252", errors="replace")
    texts += [damaged, None, "", "   ", items[ids[1]] * 200]
    want |= {(ids[0], len(texts) - 5), (ids[1], len(texts) - 1)}
    assert leak_found(spark, texts, items) == want


def test_leaks_of_empty_tables_and_short_items(spark, items):
    text = next(iter(items.values()))
    assert leak_found(spark, [], items) == set()
    assert leak_found(spark, [text], {1: None, 2: "", 3: "too short to count"}) == set()
    assert leak_found(spark, [text, text], {1: text, 2: text}) == {(1, 0), (1, 1), (2, 0), (2, 1)}


RUSSIAN = "В начале осени суд первой инстанции рассмотрел жалобу владельца старой мельницы на решение городского совета и установил что договор аренды был расторгнут без уведомления а плата за два года осталась невозвращённой поэтому ответчик обязан вернуть деньги"
GREEK = "το δικαστήριο έκρινε ότι η σύμβαση μίσθωσης του παλαιού μύλου λύθηκε χωρίς προειδοποίηση και ότι ο εναγόμενος οφείλει να επιστρέψει τα μισθώματα δύο ετών στον ιδιοκτήτη της γης μαζί με τους νόμιμους τόκους"
CHINESE = "法院認為原告提出的證據不足以證明被告在合同到期之前擅自解除租賃關係並拒絕退還押金因此駁回全部訴訟請求"


def test_leaks_in_other_scripts(spark):
    items = {1: RUSSIAN, 2: GREEK, 3: CHINESE}
    texts = [f"Plain words before. {RUSSIAN.upper()} and after.", f"x {GREEK} y", f"前文不同。{CHINESE}後文。", "Совсем другой текст о погоде и о море без всякой связи с делом", "其他內容與此無關" * 5]
    assert leak_found(spark, texts, items) == {(1, 0), (2, 1), (3, 2)}
    # Latin text whose encoding is wrong keeps its numbers
    text = "Le procès-verbal a été déposé à côté de la forêt – où est-elle ? À l’été dernier"
    for page in ("cp1251", "koi8-r", "iso8859-7", "cp866"):
        assert numbers(decode(text.encode(), page)) == numbers(text)
    assert numbers("мир и Море") == numbers("море") != numbers("горе") and len(numbers("天地42玄黄x")) == 6


def test_a_long_repetitive_document(spark, items):
    text = items[sorted(items)[2]]
    assert leak_found(spark, [(text + " ") * 300], {7: text}) == {(7, 0)}


def test_stock_sentences_are_no_leak(spark, items):
    stock = "The parties were given the full opportunity to comment on the whole file and neither of them asked the court for any further hearing of witnesses in this matter at all"
    docs = [f"{stock} {k} number {k * 7}." for k in range(40)]
    assert leak_found(spark, docs, {1: stock + " and so it was decided."}) == set()


def test_a_passage_that_leaks_often_is_no_stock_sentence(spark):
    item = (
        "Belkar Dunstov paid 6,564 crowns for the printing stone in the autumn of 2001, and the pilot withheld the minutes of the meeting. "
        "Some months later Morvik Halden disputed the tidal meadow near the railway siding, although the architect retained the deposit. "
        "The salt barge was worth 1,007 crowns when Tolrin Gasper concealed the deposit at the toll house."
    )
    words = item.split()
    rng = random.Random(3)

    def filler():
        return " ".join("".join(rng.choices("bdfgklmnprst", k=5)) for _ in range(40))

    # copies of one ruling, other rulings with the whole item, and with the same two sentences
    copy = f"{filler()} {' '.join(words[3:34])} {filler()}"
    for texts in ([copy] * 40, [f"{filler()} {item} {filler()}" for _ in range(40)], [f"{filler()} {' '.join(words[:40])} {filler()}" for _ in range(40)]):
        docs = texts + [filler() for _ in range(80)]
        assert leak_found(spark, docs, {1: item}) == {(1, k) for k in range(40)}


def invented(rng, n):
    return ["".join(rng.choices("bdfgklmnprst", k=5)) for _ in range(n)]


def test_a_loose_likeness_does_not_hide_a_passage(spark):
    rng = random.Random(5)
    item = invented(rng, 120)
    loose = [w if k % 18 < 12 else invented(rng, 1)[0] for k, w in enumerate(item)]
    texts = [[*item[40:68], *invented(rng, 50), *loose], [*loose, *invented(rng, 50), *item[40:68]], loose]
    assert leak_found(spark, [" ".join(x) for x in texts], {1: " ".join(item)}) == {(1, 0), (1, 1)}


def test_a_header_within_a_short_passage(spark):
    rng = random.Random(7)
    item, texts = invented(rng, 60), []
    for header in ("- 3 -", "High Court of Ropa - Case No. RVF-2004-0000429 - page 3", " ".join(invented(rng, 18))):
        for at in (12, 13):
            for changed in ((), (6, 19)):
                part = [w if k not in changed else "bdfgk" for k, w in enumerate(item[20:48])]
                texts.append(" ".join([*invented(rng, 60), *part[:at], header, *part[at:], *invented(rng, 60)]))
    apart = " ".join([*invented(rng, 60), *item[20:32], *invented(rng, 30), *item[32:45], *invented(rng, 60)])
    assert leak_found(spark, [*texts, apart], {1: " ".join(item)}) == {(1, k) for k in range(len(texts))}


def test_sainte_lague_is_one_seat_after_the_other():
    rng = random.Random(2)
    for _ in range(100):
        w = [rng.random() for _ in range(5)]
        cap = [rng.randrange(0, 30) for _ in w]
        n = rng.randrange(0, 60)
        got = [0] * 5
        for _ in range(min(n, sum(cap))):
            k = max((i for i in range(5) if got[i] < cap[i]), key=lambda i: (w[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        assert sainte_lague(w, n, cap) == got
    assert sainte_lague([], 5) == [] and sainte_lague([0.0, 1.0], 3) == [0, 3]


def test_mixture(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("big", 3000), ("mid", 600), ("small", 150)):
        rows += [(len(rows) + k, source, "word " * rng.randrange(5, 60)) for k in range(n)]
    rows += [(90_001, "big", None), (90_002, None, "words of no source"), (90_003, "other", "words of another"), (None, "mid", "no id"), (5, "big", "twice"), (5, "big", "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"h": F.lit(1), "n": F.lit(2), "quota": F.lit(3)})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.3, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(docs, targets, shard_tokens=20_000)
    r = {x["source"]: x for x in report.collect()}
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert r["absent"]["actual_share"] == 0
    for source, share in (("big", 0.5), ("mid", 0.2), ("small", 0.3)):
        assert abs(r[source]["actual_share"] - share) < 0.01
    most = {x["source"]: x["m"] for x in mixed.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["big"] <= 1 and most["mid"] <= 2 and most["small"] <= 4
    again, _ = mix_sources(docs, targets, shard_tokens=20_000)
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    _, more = mix_sources(docs, targets, total_tokens=10**9)
    assert all(x["most_copies"] <= {"big": 1, "mid": 2, "small": 4, "absent": 0}[x["source"]] for x in more.collect())
    none, report = mix_sources(docs.limit(0), targets)
    assert none.count() == 0 and report.filter("actual_share = 0").count() == 4


@pytest.mark.parametrize("how", [{}, {"blocks": 20, "shard_tokens": 20_000}, {"blocks": 20, "shard_tokens": 2_000}, {"blocks": 7, "shard_tokens": 300, "shard_blocks": 1}])
def test_shares_hold_whatever_the_blocks_and_shards(spark, how):
    """The size and the shares of a mixture don't depend on how blocks and shards relate."""
    rng = random.Random(12)
    rows = [(k, "abcd"[min(3, int(rng.expovariate(0.8)))], "word " * rng.randrange(3, 200)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(docs, targets, **how)
    r = {x["source"]: x for x in report.collect()}
    full = min(r[s]["available_tokens"] * m / w for s, w, m in (("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.1, 3)))
    block = full / how.get("blocks", 100_000)
    total = sum(x["tokens"] for x in r.values())
    assert abs(total - full) <= max(block, 0.01 * full)
    for x in r.values():
        assert abs(x["tokens"] - x["target_share"] * full) <= max(block, 0.01 * full)
    assert mixed.groupBy().agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == total
    assert all(x["most_copies"] <= {"a": 1, "b": 2, "c": 3, "d": 3}[x["source"]] for x in r.values())


CLEAN = {
    "fr": "L’été dernier, Élodie a reçu 3 000 écus à côté de la forêt ; où est-elle ? « Ça va », dit-il. Le procès-verbal a été déposé chez le notaire, même à l’écluse. ",
    "de": "Die Prüfstelle erklärte, dass das Gemälde im Büro der Behörde größer sei. „Schöne Grüße“, heißt es in der Erklärung für die Fähre. ",
    "es": "¿Acaso el señor rechazó la grúa en el jardín? Según el artículo, también se fijó la compañía; así lo afirmó el niño. ",
    "pl": "Spółka zapłaciła dług, ponieważ sąd okręgowy później oddalił skargę. Według biegłego przewoźnik obciążył właściciela żądaną kwotą. ",
    "en": "The court – in § 5 of the Act – awarded £300 to the claimant’s naïve café owner. ",
}
SWAPS = [("utf-8", "cp1252", "de"), ("utf-8", "latin-1", "fr"), ("utf-8", "mac_roman", "es"), ("utf-8", "cp437", "de"), ("utf-8", "cp850", "fr"), ("utf-8", "cp1251", "pl"), ("cp1252", "cp437", "de"), ("cp1252", "cp850", "es"), ("cp1252", "mac_roman", "fr"), ("cp1250", "cp1252", "pl")]


def test_garbled(spark):
    rng = random.Random(6)
    rows, truth = [], {}

    def variant(lang):
        words = CLEAN[lang].split(" ") * 3
        rng.shuffle(words)
        return " ".join(words)

    for k in range(600):
        rows.append((len(rows), "abc"[k % 3], variant(rng.choice(list(CLEAN)))))
    for true, wrong, lang in SWAPS:
        for _ in range(2):
            text = variant(lang)
            truth[len(rows)] = text
            rows.append((len(rows), "a", decode(text.encode(true, errors="ignore"), wrong)))
    twice = variant("fr")
    truth[len(rows)] = twice
    rows.append((len(rows), "b", twice.encode().decode("latin-1").encode().decode("latin-1")))
    once = variant("en")
    truth[len(rows)] = once + " costs £5"
    rows.append((len(rows), None, once + " costs Â£5"))
    lost = len(rows)
    rows.append((lost, "c", "Le proc�s a eu lieu"))
    rows += [(len(rows) + k, "c", t) for k, t in enumerate([None, "", "plain", "caf&eacute; ete", "été nö", "█████ v █████", "日本語のテキスト и русский", "é" * 200_000])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"id": F.lit(1), "n_wrong": F.lit(2), "restored": F.lit(3)})
    got = {r["doc_id"]: r for r in find_garbled(docs).collect()}
    assert set(got) == set(truth) | {lost}
    assert got[lost]["restored"] is None and got[lost]["n_lost"] == 1
    wrong_letters = 0
    for d, text in truth.items():
        fixed = got[d]["restored"]
        # bytes the code page lacks were dropped on the way
        if len(fixed) == len(text):
            wrong_letters += sum(a != b for a, b in zip(fixed, text))
    assert wrong_letters <= 0.02 * sum(map(len, truth.values()))


def test_garbled_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert find_garbled(docs).count() == 0


def test_units():
    c = Cipher()
    cut = Cutter({u for u in c.originals if len(u) > 1 and any(c.swaps[z][1] == "cp1252" for _, z in c.originals[u])}, set(c.clean), False)
    assert cut.units("Ã©") == ["Ã©"] and cut.units("çã") == ["ç", "ã"] and cut.units("â€™Ã©") == ["â€™", "Ã©"]
    pages = code_pages()
    assert len(pages) > 40 and {"cp1252", "koi8_r", "mac_roman"} <= set(pages) and not {"utf_8", "cp037", "gbk"} & set(pages)


def _variant(rng, lang):
    words = CLEAN[lang].split(" ") * 3
    rng.shuffle(words)
    return " ".join(words)


def _right(got, truth):
    """Share of the characters outside ASCII that are right in the restored texts."""
    right = total = 0
    for d, text in truth.items():
        total += sum(ord(c) > 127 for c in text)
        for m in difflib.SequenceMatcher(None, text, got[d]["restored"] or "", autojunk=False).get_matching_blocks():
            right += sum(ord(c) > 127 for c in text[m.a : m.a + m.size])
    return right / total


SENTENCE = "L’été dernier, Élodie a reçu où elle était une forêt à côté du théâtre ; voilà le procès-verbal du siège."


@pytest.mark.parametrize(
    "true, wrong", [("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "iso8859-7"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "iso8859-7"), ("cp1252", "cp1253")]
)
def test_swaps_that_are_singled_out_nowhere(spark, true, wrong):
    rng = random.Random(8)
    rows = [(k, "abc"[k % 3], _variant(rng, rng.choice(list(CLEAN)))) for k in range(300)]
    truth = {1000 + k: SENTENCE for k in range(40)}
    rows += [(d, "a", decode(t.encode(true), wrong)) for d, t in truth.items()]
    got = {r["doc_id"]: r for r in find_garbled(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert set(got) == set(truth)
    assert _right(got, truth) >= 0.9


@pytest.mark.parametrize("pages", [None, {}])
@pytest.mark.parametrize("kind", ["bytes", "letters"])
def test_an_unknown_page_is_learnt(spark, pages, kind):
    """A page that nobody knows: bytes of UTF-8, or the letters themselves, become characters of another script in random order."""
    rng = random.Random(9)
    # in these few sentences such characters stand in one place only, where others would do as well
    plain = str.maketrans("Éà’", "Eax", "«»„“")
    script = [chr(c) for c in range(0x1200, 0x1300) if chr(c).isalpha()]
    rng.shuffle(script)
    page = {chr(c): script[c - 128] for c in range(128, 256)} if kind == "bytes" else dict(zip("éèçêôâîûäöüß", script))
    rows = [(k, "abc"[k % 3], _variant(rng, rng.choice(list(CLEAN)))) for k in range(600)]
    truth = {1000 + k: _variant(rng, rng.choice(["fr", "de"])).translate(plain) for k in range(150)}
    for d, t in truth.items():
        rows.append((d, "a", "".join(page.get(c, c) for c in (t.encode().decode("latin-1") if kind == "bytes" else t))))
    got = {r["doc_id"]: r for r in find_garbled(spark.createDataFrame(rows, "doc_id long, source string, text string"), pages=pages).collect()}
    assert set(got) == set(truth)
    assert _right(got, truth) >= 0.9


def test_what_is_learnt_decides(spark):
    """Without the share that a swap is learnt to have, a lone sign is a sign."""
    rng = random.Random(10)
    rows = [(k, "a", _variant(rng, rng.choice(list(CLEAN))) + f"Processo n.º {k}") for k in range(300)]
    rows += [(1000 + k, "a", decode(_variant(rng, "es").encode("cp1252"), "cp850")) for k in range(40)]
    # º read as cp850, alone: wrong where the corpus has that swap, a sign of its own where it hasn't
    rows.append((2000, "a", "Processo n.║ 12"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    with_swap = {r["doc_id"] for r in find_garbled(docs).collect()}
    without = {r["doc_id"] for r in find_garbled(docs.filter("doc_id < 1000 or doc_id = 2000")).collect()}
    assert with_swap == {*range(1000, 1040), 2000} and without == set()


def test_executors_need_no_package(tmp_path):
    """Workers without any path to the package run the text operators."""
    root = Path(__file__).resolve().parents[2]
    script = f"""
import importlib.util, os, sys
for name in list(os.environ):
    if name == "PYTHONPATH":
        del os.environ[name]
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "2g").getOrCreate()
sys.path.insert(0, {str(root)!r})
from millrace.llm.encoding import find_garbled
from millrace.llm.leaks import find_leaks
def there(x):
    import importlib.util
    return importlib.util.find_spec("millrace") is not None
assert not s.sparkContext.parallelize([1], 1).map(there).first()
item = " ".join(f"wort{{k}}laut{{k * 7}}" for k in range(60))
docs = s.createDataFrame([(1, "a", "x " + item + " y"), (2, "a", "Le procÃ¨s Ã  Paris"), (3, "a", "Le procès à Paris")], "doc_id long, source string, text string")
assert {{r["doc_id"] for r in find_leaks(docs, s.createDataFrame([(7, item)], "item_id long, text string")).collect()}} == {{1}}
assert {{r["doc_id"] for r in find_garbled(docs).collect()}} == {{2}}
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "done" in run.stdout, run.stderr[-3000:]


def test_shares_of_the_query(spark, sf):
    rows = QUERIES["p7_shares_held"](spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == 6 and all(r["share_held"] and r["repeats_held"] and r["adds_up"] for r in rows)


@pytest.mark.parametrize("name", ["p6_passages", "p7_shares", "p8_restored"])
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_short_passages_and_sentences_of_one_pattern(spark, items):
    """A short passage with one word in eight changed is found; a sentence that has only the pattern of one isn't."""
    rng = random.Random(15)
    texts, want = [], set()
    for i in sorted(items):
        w = items[i].split()
        if len(w) >= 40 and len(want) < 60:
            part = w[6:34]
            for at in rng.sample(range(1, 27), 3):
                part[at] = "".join(rng.choices("bdfgklmnprst", k=6))
            texts.append(" ".join([*invented(rng, 40), *part, *invented(rng, 40)]))
            want.add((i, len(texts) - 1))
    found = leak_found(spark, texts, items)
    assert found <= want and len(found) >= 0.85 * len(want)


def plain_stretch(m, least, rate):
    """What an alignment of one pair gives, match after match: first word, words and errors of its best stretch."""
    n = len(m.i)
    score, back, errors = [1] * n, [-1] * n, [0] * n
    own, told, root = [int(x) for x in m.own], m.weight.tolist(), list(range(n))
    for k in range(n):
        most = 0
        for b in range(k):
            di, dj = int(m.i[k] - m.i[b]) - 1, int(m.j[k] - m.j[b]) - 1
            if di > 11:
                continue
            added = dj if dj - di <= 4 else di + 1 if dj - di <= 18 else 99
            cost = max(di, added) if di >= 0 and dj >= 0 else 99
            if score[b] - cost > most:
                most, back[k], score[k], errors[k] = score[b] - cost, b, score[b] - cost + 1, errors[b] + cost
        if back[k] >= 0:
            own[k], told[k], root[k] = own[k] + own[back[k]], told[k] + told[back[k]], root[back[k]]
    chain = [0] * n
    for place, k in enumerate(sorted(range(n), key=lambda k: -score[k])):
        chain[k] = place
    for k in reversed(range(n)):
        if back[k] >= 0:
            chain[back[k]] = min(chain[back[k]], chain[k])
    best = None
    for t in range(n):
        f = t
        while f >= 0:
            span, wrong = int(m.end[t] - m.at[f]) + 1, errors[t] - errors[f]
            tells = told[t] - told[f] + m.weight[f] >= 0.82 * (m.told_to[t] - m.told_before[f])
            if span >= least and own[t] - own[f] >= least * 0.4 and (wrong <= (span - 11) * rate or wrong <= span * 0.125 + 0.5 and tells):
                found = (chain[t], -span, f, t)
                best = found if best is None or found < best else best
            f = back[f]
    return best and (int(m.at[best[2]]), -best[1], errors[best[3]] - errors[best[2]])


def damaged_passages(rng, items, n):
    """Texts with parts of items, words changed, left out, repeated and added."""
    texts = []
    for k in range(n):
        w = rng.choice(items)
        start = rng.randrange(len(w) // 2)
        part = list(w[start : start + rng.choice((12, 26, 32, 60, 150))])
        for _ in range(rng.randrange(len(part) // 5)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice(([], invented(rng, 1), [part[at]] * 2, [*invented(rng, 9), part[at]]))
        part = part * 12 if k % 25 == 0 else part
        texts.append([*invented(rng, 20), *part, *rng.choice(items)[:6], *part[: rng.choice((0, 9, 30))], *invented(rng, 20)])
    return texts


@pytest.mark.parametrize("most", [1, 3_000, 200_000])
def test_pairs_aligned_together_give_what_each_gives_by_itself(monkeypatch, most):
    rng = random.Random(31)
    few = invented(rng, 25)  # words that recur
    items = [[rng.choice(few) if rng.random() < 0.3 else x for x in invented(rng, n)] for n in (30, 60, 120, 260)]
    index = ItemIndex([*range(4)], [" ".join(x) for x in items])
    index.own[40:52] = False
    words, doc, _ = word_numbers(pa.array([" ".join(x) for x in damaged_passages(rng, items, 150)]))
    asked = []
    near = index._near

    def kept(*x):
        asked.append((int(x[1][x[2][0]]), int(index.item[x[3][0]]), near(*x)))
        return asked[-1][2]

    monkeypatch.setattr(index, "_near", kept)
    monkeypatch.setattr(leaks, "_MATCHES", most)
    found = index.verified(words, doc, 25, 0.2)
    want = [(d, i, *best) for d, i, m in asked if (best := plain_stretch(m, 25, 0.2))]
    assert found == want and 50 < len(want) < len(asked) and max(len(m.i) for _, _, m in asked) > 500


def test_many_pairs_cost_less_than_each_by_itself():
    """Most of the time over a corpus went into aligning one pair after the other: 200 at once took as long as 200 calls."""
    rng = random.Random(32)
    items = [invented(rng, 200) for _ in range(20)]
    index = ItemIndex([*range(20)], [" ".join(x) for x in items])
    words, doc, _ = word_numbers(pa.array([" ".join([*invented(rng, 20), *rng.choice(items)[20:180], *invented(rng, 20)]) for _ in range(200)]))

    def timed(parts):
        began = time.process_time()
        found = sorted((int(d[r[0]]), *r[1:]) for w, d in parts for r in index.verified(w, d - d[0], 25, 0.2) for d in [np.unique(d)])
        return found, time.process_time() - began

    index.verified(words[:400], doc[:400], 25, 0.2)
    alone, each = timed([(words[doc == k], doc[doc == k]) for k in range(200)])
    found, together = timed([(words, doc)])
    assert found == alone and len(found) == 200
    assert together < each / 4


def test_windows_left_early_and_texts_in_blocks_change_nothing(monkeypatch, items):
    rng = random.Random(33)
    index = ItemIndex([*items], [*items.values()])
    held = [*items.values()]
    mixed = [" ".join([*invented(rng, 9), *rng.choice(held).split()[3:40], *rng.choice(held).split()[:20]]) for _ in range(60)]
    texts = pa.array([None, *mixed, "", "Это письмо пришло", *mixed[:3], None])
    whole = word_numbers(texts)
    monkeypatch.setattr("millrace.llm.words._AT_ONCE", 500)
    assert all(np.array_equal(a, b) for a, b in zip(word_numbers(texts), whole))
    begin = np.arange(len(whole[0]))
    padded = np.append(whole[0], np.zeros(leaks.STEPS + 1, dtype=np.uint32))
    assert all(len(index._keys(padded, begin, w)[1]) < len(begin) * 0.9 for w in range(leaks.WALKS))
    hits = index.hits(whole[0])
    index.begun[:] = True
    assert len(hits[0]) > 1_000 and all(np.array_equal(a, b) for a, b in zip(index.hits(whole[0]), hits))
