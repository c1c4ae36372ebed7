"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, exact_dedup, html_text, langid, pseudonyms, quality, queries, simhash, substring_dedup, suffix_array, warc
from millrace.llm.components import connected_components
from millrace.llm.shared import Workspace

AWKWARD = [(1, None), (2, ""), (3, "   "), (4, "Abc def ghi"), (5, "abc DEF ghi"), (5, "abc DEF ghi"), (None, "abc def ghi"), (7, "x" * 30000), (8, "é\u0000ß 日本語 🙂"), (9, None)]


def frame(spark, rows=AWKWARD):
    """Odd rows, with further columns named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "kept", "fp", "uid", "content", "words", "id", "n_tokens", "lang_pred", "_mr_text_x"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# 1 language identification


def test_language_held_out(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(i, "der und die das nicht ist " * 5, "de") for i in range(20, 40)] + [(i, "the and of to with is " * 5, "en") for i in range(40, 60)]
    docs = spark.createDataFrame([(i, t, None) for i, t in AWKWARD] + rows, "doc_id long, text string, lang string")
    got = langid.language_id(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[1]["score"] == 0
    assert by[25]["lang_pred"] == "de" and by[45]["lang_pred"] == "en"
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_clashing_columns_and_repeats(spark):
    """Few ids, each repeated often, are learned from; the whole of a text decides; other columns don't matter."""
    rows = [(i % 3, "der und die das nicht ist wir haben " * 20, "de") for i in range(600)] + [(10 + i % 3, "the and of to with is we have " * 20, "en") for i in range(600)]
    rows += [(50, "the and of to " * 30 + "der und die das nicht " * 3000, None), (51, None, None), (None, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("lang_pred", "score", "held_out", "id", "l", "bytes", "_mr_text"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = langid.language_id(docs, sample_docs=1).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 50)} == {"de"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (10, 11, 12, None)} == {"en"}
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)


def test_language_sample_is_whole_texts_within_its_bytes(spark):
    rows = [(i, f"w{'x' * (i % 50)} und die das " * 10, "de") for i in range(100)] + [(200, "the and of " * 5000, "en")]
    got = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary_bytes=3000)
    texts = {langid._clean(langid._words(t)) for _, t, _ in rows}
    assert 1500 < len(got["de"]) <= 3100 and got["en"] in texts
    rest = got["de"]
    while rest:
        whole = next(t for t in texts if rest.startswith(t))
        rest = rest[len(whole) :]


def test_narrow_margin_is_rejected():
    model = langid.LanguageModel({"a": b" the and of to " * 500, "b": b" the and of to " * 500})
    assert model.predict("the and of to")[2] == 0.0


# 2 SimHash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, tau=2):
    own = list(range(len(ids)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                own[root(i)] = root(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("cap", [1024, 1])
def test_simhash_brute_force(spark, sf, cap):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text").filter("doc_id is null or doc_id <> 1"))
    rows = docs.collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    want = Counter(zip((r["doc_id"] for r in rows), (f"{p:016x}" for p in prints), slow_components([r["doc_id"] for r in rows], prints)))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(docs, key_cap=cap).collect())
    assert got == want


def test_simhash_links_of_near_prints(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints for _ in range(6)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for cap in (1024, 3):
        work = Workspace(spark, "t")
        roots = {r["node"]: r["root"] for r in connected_components(simhash.hamming_links(df, work, key_cap=cap), work).collect()}
        want = slow_components(signed, [p & (1 << 64) - 1 for p in signed])
        assert [roots.get(p, p) for p in signed] == want


def slow_sets(texts, words=5):
    out = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset())
    return out


def slow_similar(ids, texts, similarity=0.8):
    """Smallest id by component of the links of Jaccard similarity."""
    sets, own = slow_sets(texts), list(range(len(ids)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9:
                own[root(i)] = root(j)
    least = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return {least[root(i)] for i in range(len(ids))}


@pytest.mark.parametrize("hot_key", [64, 2])
def test_similar_sets_brute_force(spark, hot_key):
    """Chains of edits, copies of all sizes, one passage in all of a third of the texts."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 40, 200, 600]))
        if i % 3 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 60))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    texts += ["", None, "  ", " ".join(passage), " ".join(passage[1:])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.keep_similar_representatives(docs, hot_key=hot_key).collect()}
    assert got == slow_similar([k for k, _ in rows], [t for _, t in rows])


def test_set_prints_of_alike_sets_are_near():
    """Over many pairs at the threshold none is beyond the bits allowed, and unlike sets are."""
    rng = np.random.default_rng(14)
    for n in (20, 40, 100, 500, 3000):
        for _ in range(60):
            common = rng.integers(0, 1 << 63, round(n * 8 / 9), dtype=np.uint64)
            a, b = (np.unique(np.r_[common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]) for _ in range(2))
            near, far = ((simhash._set_print(a) ^ simhash._set_print(x)).view(np.uint64) for x in (b, rng.integers(0, 1 << 63, n, dtype=np.uint64)))
            assert int(np.bitwise_count(near).sum()) <= simhash.SET_BITS < int(np.bitwise_count(far).sum())


def test_similar_sets_odd_rows(spark):
    clash = frame(spark).withColumn("_gone_id", F.lit(1)).withColumn("_gone_mark", F.lit(2)).withColumn("node", F.lit("x")).withColumn("mark", F.lit("y"))
    kept = simhash.keep_similar_representatives(clash)
    assert kept.columns == clash.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in kept.collect()) == [("1", ""), ("4", "Abc"), ("7", "xxx"), ("8", "é\u0000ß")]
    assert simhash.keep_similar_representatives(clash.limit(0)).count() == 0


def test_pigeonring_never_misses():
    rng = random.Random(6)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(2):
            b ^= 1 << rng.randrange(64)
        assert any(all(((a ^ b) & m).bit_count() <= budget for m, budget in simhash.chain_masks(i, 2)) for i in range(simhash.SEGMENTS))


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["root"] for r in connected_components(edges, Workspace(spark, "t")).collect()} == {0}


def test_simhash_odd_rows(spark):
    assert simhash.simhash_dedup(frame(spark)).count() == len(AWKWARD)
    assert simhash.simhash_dedup(frame(spark).limit(0)).count() == 0
    kept = simhash.keep_representatives(frame(spark))
    assert sorted(kept.columns) == sorted(frame(spark).columns)
    by = [r["doc_id"] for r in kept.collect()]
    assert 1 in by and 2 not in by and 9 not in by  # wordless texts are one component


# 3 BPE


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary_path()


def test_bpe_equals_library(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    own = bpe.WordBPE(open(vocabulary, encoding="utf-8").read())
    rng = random.Random(1)
    odd = [chr(c) for c in range(0x250)] + list("́Σİ\u0085 　\U0001f600一가ẞΩﬁ٠")
    texts = ["", "<|endoftext|>a<|startoftext|>", "tttttttt", "ΑΣ ΣΑΣ", "it's they're I'LL"]
    texts += ["".join(rng.choices(odd if i % 2 else "abcdefghijklmnopqrstuvwxyz' tes", k=rng.randint(0, 40))) for i in range(6000)]
    for text, (n, ids, decoded) in zip(texts, own.summaries(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == want and n == len(want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_words_equal_library(vocabulary, sf, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    got = bpe.bpe_encode(docs, vocabulary).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, vocabulary):
    assert bpe.bpe_encode(frame(spark), vocabulary).count() == len(AWKWARD)
    assert bpe.bpe_encode(frame(spark).limit(0), vocabulary).count() == 0


# 4 decontamination


def slow_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow_found(doc, item, window=13, share=0.8):
    span = min(window, len(item))
    for shift in range(-len(item), len(doc) + 1):
        same = [doc[shift + j] == item[j] for j in range(len(item)) if 0 <= shift + j < len(doc)]
        if any(sum(same[p : p + span]) >= np.ceil(span * share) for p in range(len(same) - span + 1)):
            return True
    return False


def test_contamination_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 8, 15, 40])))) for i in range(12)] + [(99, "too short"), (98, None)]
    docs = []
    for i in range(60):
        body = rng.choices(words, k=60)
        part = items[i % 12][1].split()
        for _ in range(i % 4):
            part[rng.randrange(len(part))] = "changed"
        body[20:20] = part
        docs.append((i, " ".join(body).title()))
    df = spark.createDataFrame(docs + [(None, None), (100, "")], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, s in items if len(slow_words(s)) >= 5 and slow_found(slow_words(t), slow_words(s))}
    for block in (decontaminate.BLOCK_SEEDS, 100):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench, block_seeds=block).collect()}
        # items shorter than the window may lose all seeds to three substitutions
        assert got <= want and {x for x in want if len(slow_words(dict(items)[x[1]])) >= 15} <= got
    assert decontaminate.decontaminate(df, bench).count() == df.count() - len({d for d, _ in got})
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 == decontaminate.contamination(df, bench.limit(0)).count()


def test_masks_leave_a_hit():
    from itertools import combinations

    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(not {p + o for o in m} & set(gone) for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - m[-1]))


def test_masks_leave_a_hit_at_all_lengths():
    from itertools import combinations

    for n in range(decontaminate.LEAST_WORDS, decontaminate.WINDOW):
        for gone in combinations(range(n), n - int(np.ceil(n * decontaminate.SIMILARITY))):
            assert any(not {p + o for o in m} & set(gone) for m in (*decontaminate.MASKS, *decontaminate.SHORT_MASKS) for p in range(n - m[-1])), (n, gone)


def test_contamination_of_short_items(spark):
    from itertools import combinations

    docs, items = [], []
    for n in range(1, 13):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in [(), *combinations(range(n), max(1, n - int(np.ceil(n * decontaminate.SIMILARITY))))]:
            docs.append((len(docs), " ".join(["before", *["other" if k in gone else w for k, w in enumerate(item)], "after"])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (0, None), (-1, "!")], "item_id long, text string")
    want = {(d, i) for d, t in docs for i, s in items if slow_found(slow_words(t), slow_words(s))}
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench, short_items=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = dict(items)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()} == {x for x in want if len(kept[x[1]].split()) >= 5}
    assert decontaminate.decontaminate(df, bench, short_items=True).count() == len(docs) - len({d for d, _ in want})


# 5 exact dedup


@pytest.mark.parametrize("table_bytes", [48 << 20, 2000])
def test_exact_dedup_brute_force(spark, sf, table_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text"))
    groups = {}
    for r in docs.collect():
        groups.setdefault((r["text"] or "").encode().lower(), []).append(r["doc_id"])
    got = exact_dedup.exact_dedup(docs, table_bytes=table_bytes).collect()
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(by_sha.keys())
    assert exact_dedup.keep_first_copies(docs, table_bytes=table_bytes).count() == len(by_sha)


def test_exact_dedup_odd_rows(spark):
    assert exact_dedup.exact_dedup(frame(spark)).count() == len(AWKWARD)
    assert exact_dedup.exact_dedup(frame(spark).limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(frame(spark))
    assert kept.columns == frame(spark).columns and {r["score"] for r in kept.collect()} == {"clash"}


def test_content_table_probes_and_compares():
    table = exact_dedup.ContentTable(4)
    for i in range(100):
        assert table.find_or_add(7, str(i).encode()) == (i, True)
    assert all(table.find_or_add(7, str(i).encode()) == (i, False) for i in range(100))


# 6 pseudonyms


def slow_feistel(left, right, a, b, key, kind):
    def f(turn, half, m):
        return int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:15], 16) % m

    for i in range(1, pseudonyms.ROUNDS + 1):
        left = (left + f(2 * i, right, a)) % a
        right = (right + f(2 * i + 1, left, b)) % b
    return left, right


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + (i & 1)), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_brute_force(spark):
    key = "k"
    texts = ["4111111111111111", "4111 1111 1111 1111", "10.0.0.255", "2021-02-28", "12/31/1999", "31.12.1999", "123-45-6789", "899-99-9999", "DE89370400440532013000", "+1 (017) 555-7713", "a.b@c.de"]
    got = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), key).collect()]
    l, r = slow_feistel(int("1111111"), int("1111111"), 10**7, 10**7, key, "card14")
    assert got[0][:15] == f"4{l:07d}{r:07d}" and luhn(got[0]) and got[1].replace(" ", "") == got[0]
    l, r = slow_feistel(10 * 256, 255, 65536, 65536, key, "ipv4")
    assert got[2] == f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    import datetime

    k = (datetime.date(1999, 12, 31) - datetime.date(1800, 1, 1)).days
    l, r = slow_feistel(k // 773, k % 773, 189, 773, key, "date")
    day = datetime.date(1800, 1, 1) + datetime.timedelta(l * 773 + r)
    assert got[4] == day.strftime("%m/%d/%Y") and got[5] == day.strftime("%d.%m.%Y")
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[6]) and got[6] != texts[6]
    assert int(got[8][4:] + "1314" + got[8][2:4]) % 97 == 1 and got[8] != texts[8]
    l, r = slow_feistel(1755, 57713, 10**5, 10**5, key, "phone10")
    assert got[9] == f"+1 ({l:05d}"[:7] + f") {f'{l:05d}{r:05d}'[3:6]}-{f'{l:05d}{r:05d}'[6:]}"
    assert got[10].endswith("@example.org")


def test_pseudonyms_of_ibans_with_letters_and_spaces(spark):
    valid = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    texts = ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "MT84MALT011000012345MTLCAST001S", "GB82WEST12345698765433", "(GB82WEST12345698765432)."]
    got = [r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "k").collect()]
    plain = [x.replace(" ", "") for x in got]
    assert all(valid(x) for x in plain[:4]) and all(a != b and len(a) == len(b) and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(got[:4], texts))
    assert plain[0] == plain[1] and got[4] == texts[4] and got[5] == f"({got[0]})."


def test_pseudonyms_brute_force_over_whole_texts(spark):
    """Candidates in long texts: what is found, kept and linked, against plain expressions and checks."""
    rng = random.Random(13)
    words = ["plain", "4111111111111111", "4111111111111112", "10.1.2.3", "300.1.2.3", "2020-02-29", "2021-02-29", "a.b@c.de", "no@", "123-45-6789", "000-45-6789"]
    good = {"4111111111111111", "10.1.2.3", "2020-02-29", "a.b@c.de", "123-45-6789"}
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 5, 3000])))) for i in range(12)]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    seen = {}
    for i, text in rows:
        before, after = text.split(), out[i]["text"].split()
        assert len(before) == len(after) and out[i]["n_values"] == sum(w in good for w in before)
        for a, b in zip(before, after):
            assert (a != b) == (a in good) and seen.setdefault(a, b) == b


def test_pseudonyms_empty_table_and_clashing_columns(spark):
    odd = frame(spark).withColumn("_mr_found", F.lit("x")).withColumn("_mr_new", F.lit("y"))
    got = pseudonyms.pseudonymise(odd, "k")
    assert got.columns == [*odd.columns, "n_values"] and {(r["_mr_found"], r["_mr_new"]) for r in got.collect()} == {("x", "y")}
    assert pseudonyms.pseudonymise(odd.limit(0), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    a, b = 7, 11
    df = spark.range(a * b).select(pseudonyms.feistel((F.col("id") / b).cast("int"), F.col("id") % b, F.lit(a), F.lit(b), F.lit("k"), F.lit("t")).alias("s")).distinct()
    assert df.count() == a * b and df.filter(f"s.l >= {a} or s.r >= {b} or s.l < 0 or s.r < 0").count() == 0


def test_pseudonyms_leave_the_rest(spark):
    texts = ["4111111111111112", "300.1.1.1", "2021-02-30", "666-45-6789", "DE89370400440532013001", "version 3.4.1", "31/12/1999", "1 2 3", "a@b", "9" * 40000, "x" * 40000, None, ""]
    out = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == texts and {r["n_values"] for r in out} == {0}
    assert pseudonyms.pseudonymise(frame(spark), "k").count() == len(AWKWARD)
    linked = pseudonyms.pseudonymise(spark.createDataFrame([("a 1.2.3.4 b 1.2.3.4.",)], "text string"), "k").first()
    assert linked["n_values"] == 2 and len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", linked["text"]))) == 1


# 7 WARC


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/x", "<p>WARC/1.1\r\n\r\nq</p>"), (2, None, None), (3, "http://www.a.b/x?q=1#f", ""), (3, "http://www.a.b/x?q=1#f", ""), (None, "bad url\r\nX: y", "é"), (7, "http://[", "é"), (8, "http://a.b/x", "y" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.archive(pages, f"file://{tmp_path}/w", file_bytes=200).collect()
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got)
    want = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        first = max(p for p in same if p is not None)
        payload = (html or "").encode()
        want.append((page, len(payload), warc.base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    named = spark.createDataFrame([("none", "a"), ("a\nb: é>", "a"), (None, "a"), ("z z", "b")], "page_id string, html string").withColumn("url", F.lit("u")).withColumn("run", F.lit("clash"))
    assert {(r["page_id"], r["refers_to"]) for r in warc.archive(named, f"file://{tmp_path}/n").collect()} == {("none", None), ("a\nb: é>", "none"), (None, "none"), ("z z", None)}
    small = warc.archive(pages, f"file://{tmp_path}/m", min_revisit_bytes=10).filter("payload_bytes < 10").collect()
    assert {r["record_type"] for r in small} == {"response"}


# 8 quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_sum_of_squares_identity():
    fm = quality.FactorisationMachine(20)
    index, value = np.array([1, 4, 9, 13]), np.array([0.5, -1.0, 2.0, 0.3])
    pairs = sum(fm.v[index[i]] @ fm.v[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(np.log(fm.score(index, value) / (1 - fm.score(index, value))), pairs)


def test_fitted_machine_scores_all_pairs():
    """The score of a fitted machine is that of all pairs, written out."""
    rng = np.random.default_rng(11)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.normal(size=6)) for _ in range(200)]
    labels = np.array([float(v[0] * v[1] > 0) for _, v in rows])
    fm = quality.FactorisationMachine(30).fit(rows, labels, steps=200)
    for index, value in rows[:50]:
        z = fm.bias + sum(fm.w[i] * x for i, x in zip(index, value)) + sum(fm.v[index[i]] @ fm.v[index[j]] * value[i] * value[j] for i in range(6) for j in range(i))
        assert np.isclose(fm.score(index, value), 1 / (1 + np.exp(-z)))


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality.quality(frame(spark), labels).collect()
    assert len(got) == len(AWKWARD) and len({r["score"] for r in got if r["doc_id"] in (1, 2, 9)}) == 1
    assert quality.quality(frame(spark).limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality(frame(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(frame(spark), labels).columns == frame(spark).columns
    clash = frame(spark).withColumn("_mr_score", F.lit("clash")).withColumn("held_out", F.lit(1)).withColumn("label", F.lit(2)).withColumn("_id", F.lit(3))
    assert sorted(map(str, quality.quality(clash, labels).collect())) == sorted(map(str, got))
    assert quality.keep_good(clash, labels).columns == clash.columns
    long = spark.createDataFrame([(1, "good words here. " * 300_000)], "doc_id long, text string")
    assert 0 <= quality.quality(long, labels).first()["score"] <= 1


# 9 substrings


def test_suffix_array_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 20])
        t = np.array([rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0], np.uint8)
        b = bytes(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array.suffix_array(t)
        assert sa.tolist() == want
        lcp = suffix_array.permuted_lcp(t, sa)
        for x, y in zip(want, want[1:]):
            n = next((n for n in range(len(b)) if x + n >= len(b) or y + n >= len(b) or b[x + n] != b[y + n]), len(b))
            assert lcp[y] == n


def slow_spans(rows, w):
    count = Counter(b[i : i + w] for _, b in rows for i in range(len(b) - w + 1))
    out = []
    for key, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out.append((key, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_bytes", [4 << 20, 300])
def test_substrings_brute_force(spark, group_bytes):
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcd é", k=rng.randint(30, 200))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), "".join(rng.choices("wxyz", k=rng.randint(5, 60)))]) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(100, None), (101, "a" * 500), (102, "ab" * 300), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit("clash")).withColumn("n_bytes", F.lit(1))
    got = substring_dedup.substring_dedup(df, window=40, gram=16, group_bytes=group_bytes, shard_bytes=2000)
    assert Counter(map(tuple, got.collect())) == slow_spans([(k, (t or "").encode()) for k, t in rows], 40)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_substrings_of_one_gram_in_many_texts(spark):
    """One passage in all texts, between words of their own, some of them shared: groups are cut by place."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    ends = ["".join(rng.choices("stuvwxyz ", k=50)) for _ in range(30)]
    rows = [(i, rng.choice(ends)[rng.randint(0, 40) :] + passage[rng.randint(0, 9) :] + rng.choice(ends)[: rng.randint(0, 50)]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df, window=60, gram=24, group_bytes=1000, shard_bytes=3000)
    assert Counter(map(tuple, got.collect())) == slow_spans([(k, t.encode()) for k, t in rows], 60)


def test_substrings_across_stretches(spark):
    rng = np.random.default_rng(10)
    at = substring_dedup.STRETCH
    long = bytes(rng.integers(97, 123, at + 50_000, dtype=np.uint8)).decode()
    other = "!" * 300 + "?" * 300
    df = spark.createDataFrame([(1, long), (2, other[:300] + long[at - 700 : at + 900] + other[300:])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {1: (len(long), 1600, 1, hashlib.sha256((long[: at - 700] + long[at + 900 :]).encode()).hexdigest()), 2: (2200, 1600, 1, hashlib.sha256(other.encode()).hexdigest())}


# 10 HTML


def test_html_text():
    tree = html_text.grown_tree()
    page = (
        '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>'
        '<div class="ad">Buy this now</div><article><h1>Title here</h1><p>First &amp; second\n  words<br>third <b>bo</b>ld.</p><!-- <p>no</p> -->'
        '<aside><p>' + "side words " * 30 + "</p></aside><p>Short.</p><section class='comments'><p>" + "I think so too " * 20 + "</p></section></article>"
        "<form><label>Name</label></form><footer>&copy; me</footer></body></html>"
    )
    assert html_text.main_text(page, tree) == "Title here First & second words third bold. Short."
    body = "words of the story " * 12
    assert html_text.main_text(f"<div id=nav><a href=x>One</a> <a href=y>Two</a></div><div><p>{body}</p><p>{body}</p></div>", tree) == f"{body.strip()} {body.strip()}"
    for odd in (None, "", "   ", "<", "<p", '<a href="x', "<script>" * 50, "&#x0;&bogus;", "<p>" * 2000):
        assert isinstance(html_text.main_text(odd, tree), str)


def test_html_names_of_whole_page_and_empty_drawings():
    tree, body = html_text.grown_tree(), "These are words of the main text that go on for a while. " * 6
    plain = f"<html><body><article><p>{body}</p><p>{body}</p></article></body></html>"
    for old, new in (("<html>", "<html class='no-sidebar'>"), ("<body>", "<body class='modal-open has-sidebar no-comments' id=page-header>"), ("<article>", "<article class='post sponsored'>"), ("<p>", "<p><svg class='icon' viewBox=\"0 0 1 1\"/>"), ("<p>", "<p><math/>"), ("article>", "main class=no-header>")):
        assert html_text.main_text(plain.replace(old, new, 1), tree) == f"{body.strip()} {body.strip()}", new
    assert html_text.main_text(plain.replace("<p>", "<p><svg><text>drawn</text></svg>", 1), tree) == f"{body.strip()} {body.strip()}"


def test_html_keeps_all_of_an_article():
    tree, body = html_text.grown_tree(), "These are words of the main text that go on for a while. " * 6
    for inside, text in (
        ("<div class='search-results-analysis'><p>What was found, and what it means.</p></div>", "What was found, and what it means."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
        ("<ul><li><a href=1>First part</a></li><li><a href=2>Second part</a></li><li><a href=3>Third</a></li></ul>", "First part Second part Third"),
        ("<p hidden>The answer.</p><div style='display:none'><p>And the proof of it.</p></div>", "The answer. And the proof of it."),
        ("<div class='has-sidebar menu-items-explained'><p>Short.</p></div>", "Short."),
        ("<div class='comment-list'><p>" + "I think so too. " * 30 + "</p></div><div id='ad-container'>Buy</div><div class='related-posts'><a href=x>More</a></div>", ""),
    ):
        want = " ".join(x for x in (body.strip(), text, body.strip()) if x)
        assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><article class='widget-review'><p>{body}</p>{inside}<p>{body}</p></article><footer>me</footer></body>", tree) == want, inside


def test_html_many_tags_take_linear_time():
    import time

    start = time.process_time()
    page = "<div>" * 20_000 + "</b></section>" * 20_000 + "<p>end"
    assert isinstance(html_text.main_text(page, html_text.grown_tree()), str)
    assert time.process_time() - start < 5


def test_html_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Words of it.</p></article>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract_text(pages, keep=["page_id", "text", "n_chars", "html"])
    assert got.columns == ["page_id", "text", "n_chars", "html", "_text", "_n_chars"]
    assert tuple(got.select("page_id", "text", "n_chars", "_text", "_n_chars").first()) == (1, "t", 5, "Words of it.", 12)
    assert html_text.extract_text(pages.limit(0), keep=["page_id", "url"]).count() == 0


def test_html_table_is_learned():
    rows = html_text.labelled_rows()
    assert (html_text.grown_tree().predict(rows[:, :-1]) == rows[:, -1]).mean() > 0.97


def test_html_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extract_text(pages, keep=["page_id", "url"]).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)(</article>|\Z)", r["html"])[1]
        assert " ".join(html_text.html.unescape(re.sub("<[^>]*>", " ", inner)).split()) == r["text"] and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x")], "page_id long, url string, html string")
    assert html_text.extract_text(odd, keep=["page_id", "url"]).count() == 3
