"""The methods behind the operators: laws, permutations, indexes, models, each against a plain version or the truth."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import language_id, laws, mixing, pii, queries, simhash, substrings, toxicity, urls, vectors

KEY = b"k" * 32


def test_draws_follow_the_hypergeometric_law(spark):
    cases = [(50, 20, 10), (12, 3, 9), (7, 6, 1), (40_000, 300, 9_000), (10**9, 4 * 10**8, 10**5)]
    n = 6000
    rows = spark.range(n).crossJoin(spark.createDataFrame(cases, "n long, k long, q long"))
    seed = F.concat_ws("|", "id", "n")
    got = rows.select("n", laws.hypergeometric(F.col("n"), F.col("k"), F.col("q"), seed).alias("x")).groupBy("n", "x").count().collect()
    for total, k, q in cases:
        found = {r["x"]: r["count"] for r in got if r["n"] == total}
        assert sum(found.values()) == n
        lg = math.lgamma
        ln = lambda x: lg(k + 1) - lg(x + 1) - lg(k - x + 1) + lg(total - k + 1) - lg(q - x + 1) - lg(total - k - q + x + 1) - lg(total + 1) + lg(q + 1) + lg(total - q + 1)  # noqa: B023, E731
        least, most = max(0, q + k - total), min(q, k)
        mean, dev = q * k / total, math.sqrt(max(0.25, q * k / total * (1 - k / total) * (total - q) / (total - 1)))
        lo, hi = max(least, int(mean - 8 * dev) - 2), min(most, int(mean + 8 * dev) + 2)
        p = np.exp([ln(x) for x in range(lo, hi + 1)])
        assert p.sum() == pytest.approx(1, abs=1e-5) and lo <= min(found) and max(found) <= hi
        # Chi-square over stretches of about equal probability.
        edges = np.searchsorted(np.cumsum(p), np.linspace(0, 1, 21)[1:-1])
        part = np.searchsorted(edges, np.arange(len(p)), side="left")
        want = np.bincount(part, weights=p, minlength=20) * n
        have = np.bincount(part, weights=[found.get(x, 0) for x in range(lo, hi + 1)], minlength=20)
        want, have = want[want > 5], have[want > 5]
        assert ((have - want) ** 2 / want).sum() < len(want) + 5 * math.sqrt(2 * len(want))


def test_beta_probabilities(spark):
    cases = [(0.3, 0.7), (1.0, 1.0), (5.0, 2.5), (40.0, 60.0), (0.02, 3.0), (2000.0, 1900.0), (300.0, 3.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    got = [(r["a"], r["b"], r["p"], r["s"]) for r in df.select("a", "b", laws.beta_at_most(0.5, F.col("a"), F.col("b")).alias("p"), laws.beta_at_most(0.2, F.col("a"), F.col("b")).alias("s")).collect()]
    w = np.arange(-60, 20, 0.002)
    for a, b, half, fifth in got:
        for x, p in ((0.5, half), (0.2, fifth)):
            z0 = math.log(x / (1 - x))
            sides = []
            for sign in (-1, 1):
                z = z0 + sign * np.exp(w)
                sides.append(np.exp(-a * np.logaddexp(0, -z) - b * np.logaddexp(0, z) + w - a * math.log(a / (a + b)) - b * math.log(b / (a + b))).sum())
            assert p == pytest.approx(sides[0] / sum(sides), abs=1e-7)


def test_the_mix_that_is_drawn_is_the_one_that_is_reported(spark):
    rows = [(None, "a b c " * 40, "s", i) for i in range(60)] + [(7, f"w{i} " * 50, "s", i) for i in range(40)] + [(8, "same text here " * 30, "t", 1)] * 50 + [(9, None, None, 1), (10, "x y", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _s long").withColumns({c: F.lit(5) for c in ("_last", "_place", "shard", "h", "row", "doc", "size", "pass")}).repartition(5)
    reported, mix = mixing.mixed(df), mixing.drawn(df)
    assert mix.columns == df.columns
    words = mix.select("doc_id", "source", "text", "_s", "pass").collect()
    assert {r["pass"] for r in words} == {5}
    want, have = Counter(), Counter()
    for r in reported.collect():
        want[r["doc_id"], r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for r in words:
        have[r["doc_id"], r["source"]] += len((r["text"] or "").split())
    assert have == want
    # A row is drawn from in whole blocks of 16 words, none twice: its own words are told apart by their numbers.
    numbered = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(100)), "u") for i in range(30)], "doc_id long, text string, source string")
    part = [r["text"] for r in mixing.drawn(numbered).collect() if len(r["text"].split()) < 100]
    for text in part:
        at = [int(re.fullmatch(r"d\d+w(\d+)", w)[1]) for w in text.split()]
        assert at == sorted(set(at)) and all(at[i + 1] == at[i] + 1 for i in range(len(at) - 1) if at[i] % 16 != 15)
    assert part and any(int(t.split()[0].partition("w")[2]) for t in part)


def test_pseudonyms_of_each_kind_are_permutations():
    few = pii.pseudonym
    # Numbers that can be dialled and those that cannot, in one small keyed domain each: no two get one pseudonym.
    rng = random.Random(3)
    texts = [f"{rng.choice('0123456789')}{rng.randrange(100):02d}-{rng.choice('0123456789')}{rng.randrange(100):02d}-{i:04d}" for i in range(3000)]
    phones = {t: pii.pseudonymise(t, KEY)[0] for t in texts}
    assert len(set(phones.values())) == len(phones) and all(k != v for k, v in phones.items())
    dialled = lambda t: t[0] in "23456789" and t[4] in "23456789"
    assert all(dialled(k) == dialled(v) for k, v in phones.items())
    days = [(y, m, d) for y in (1899, 1999, 2000) for m in range(1, 13) for d in range(1, 29)]
    new = {t: pii.pseudonymise(f"{t[0]}-{t[1]:02d}-{t[2]:02d}", KEY)[0] for t in days}
    assert len(set(new.values())) == len(days)
    for places in ("0123456789", "01"):
        domain = [a + b + c for a in places for b in places for c in places]
        assert sorted(pii._by_places(KEY, "t", x, [places] * 3) for x in domain) == sorted(domain)
        odd = [x for x in domain if x.count("1") != 1]
        assert sorted(pii._by_places(KEY, "t", x, [places] * 3, lambda y: y.count("1") != 1) for x in odd) == sorted(odd)
    assert sorted(few(KEY, "x", i, 10) for i in range(10)) == list(range(10))
    ssn = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 2, 9999)]
    assert len({pii.pseudonymise(x, KEY)[0] for x in ssn}) == len(ssn)
    cards = [b + str(pii.luhn(b)) for b in (f"41111111111{i:04d}" for i in range(500))]
    assert len({pii.pseudonymise(c, KEY)[0] for c in cards}) == 500


def test_dates_keep_their_form_and_their_links():
    out = lambda t: pii.pseudonymise(t, KEY)[0]
    for text in ("2001-2-8", "1/2/2001", "03/04/1999", "1899-12-31", "31.12.1750", "28/2/2024", "0999-01-01"):
        new = out(text)
        assert new != text and [len(x) for x in re.split(r"\D", new)] == [len(x) for x in re.split(r"\D", text)] and re.findall(r"\D", new) == re.findall(r"\D", text)
    iso = out("1999-03-04")
    assert out("03/04/1999").split("/") == [iso[5:7], iso[8:], iso[:4]] and out("04.03.1999").split(".") == [iso[8:], iso[5:7], iso[:4]]
    assert out("2023-02-30") == "2023-02-30" and int(out("2024-02-29")[8:]) > 12


def test_secrets_by_their_names_whatever_their_characters():
    for text in ("auth_token=abcdefgh12345678", "client_secret: s3cr3tvalue99", "DB_PASSWORD=correcthorse1", "access_token = 'abcd1234efgh'", "password: P@ssw0rd!xyz", "password=hunter2", "token=eyJhbGciOi9.eyJzdWIiOjEyMzQ.SflKxwRJSMeK",
                 "Authorization: Bearer abc.def123.ghi", "passphrase: correct-horse-battery", "sk-abcdef0123456789abcd", 'clientSecret: "x y z 1 2" next', "1-800-555-1234", "030 1234567", "0049 30 1234567", "(555) 123-4567"):
        new, n = pii.pseudonymise(text, KEY)
        assert n == 1 and new != text and len(new) == len(text) and [c.isalnum() for c in new] == [c.isalnum() for c in text], text
        assert not {w for w in re.findall(r"\w{5,}", new.partition("=")[2] or new.partition(": ")[2]) if w.lower() != "bearer"} & set(re.findall(r"\w{5,}", text))
    for text in ("the secret: garden is", "Tokens: a", "password: short", "the password is secret.", "keys and tokens: many", "May 4 people", "12 March", "0 12345678"):
        assert pii.pseudonymise(text, KEY) == (text, 0)


def test_dates_in_words_are_linked_with_their_other_forms():
    out = lambda t: pii.pseudonymise(t, KEY)[0]
    year, month, day = map(int, out("1999-03-04").split("-"))
    names = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    assert out("4 March 1999") == f"{day} {names[month - 1]} {year}" and out("on MAR 04, 1999!") == f"on {names[month - 1][:3].upper()} {day:02d}, {year}!" and out("31 February 2001") == "31 February 2001"


def test_addresses_of_eight_groups():
    text = "2001:0db8:85a3:0000:0000:8a2e:0370:7334 and 2001:db8:85a3::8a2e:370:7334 but std::vector, 12:30:45, ::1"
    new, n = pii.pseudonymise(text, KEY)
    long, short = new.split()[0], new.split()[2]
    assert n == 2 and new.endswith("but std::vector, 12:30:45, ::1")
    import ipaddress

    assert ipaddress.IPv6Address(long) == ipaddress.IPv6Address(short) != ipaddress.IPv6Address("2001:db8:85a3::8a2e:370:7334")
    assert [len(g) for g in short.split(":")] == [4, 3, 4, 0, 4, 3, 4]


def test_op2_against_a_plain_pass(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    key = hashlib.sha256(queries.SECRET.encode()).digest()
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in queries.op2_pii(spark, sf_dir).collect()}
    assert got == {i: (None, 0) if t is None else pii.pseudonymise(t, key) for i, t in docs.items()}
    # Nothing that passes a check in the input is left: plainer patterns than the operator's own.
    for i, t in docs.items():
        for x in re.findall(r"[\w.]+@[\w.]+\.[a-z]+|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", t or ""):
            if "@" in x or (x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"):
                assert x not in got[i][0]


def _near(rng, v, cosine):
    d = rng.normal(size=len(v))
    d -= d @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * d / np.linalg.norm(d)


def test_vectors_of_null_ids_other_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (None, [1.0, 2.0, 3.0]), (None, [0.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [5.0] * 8), (None, [5.0] * 8), (6, [3.0, -1.0] * 4), (6, [-1.0, 3.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = Counter(tuple(r) for r in vectors.linked(df, sample=100).collect())
    want = [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False), (None, 1, None, True), (None, 1, None, True), (6, 0, 6, True), (6, 0, 6, True)]
    assert got == Counter(want)
    with pytest.raises(ValueError):
        vectors.linked(df, most_lengths=2)


@pytest.mark.parametrize("common", [0.0, 1.0, 1.83, 3.0])
def test_recall_of_pairs_at_the_threshold(spark, common):
    """Pairs of a cosine just over 0.95, in general place and in cones about a common mean, where unrelated vectors have cosines
    of about 0.5, 0.77 and 0.9 and the pairs share fewer bits."""
    rng = np.random.default_rng(8)
    mean = rng.normal(size=64)
    mean *= common / np.linalg.norm(mean)
    rows = []
    for _ in range(1500):
        v = rng.normal(size=64) / 8 + mean
        v /= np.linalg.norm(v)
        rows += [v, _near(rng, v, rng.uniform(0.9505, 0.97))]
    x = np.array(rows)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.linked(df).collect()}
    assert all(got[i] <= near[i].sum() for i in range(len(x)))
    assert sum(got.values()) >= 0.95 * near.sum()


def test_an_index_grown_in_batches_and_opened_again(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(400), rng.randrange(3), rng.random() < 0.02) for _ in range(1500)]
    cut = [0, 300, 301, 700, 1000, 1500]
    frames = [spark.createDataFrame(rows[a:z], "fp long, span long, tied boolean") for a, z in zip(cut, cut[1:], strict=False)]
    index = substrings.FingerprintIndex(spark, most_runs=3)
    touched = set()
    for i, df in enumerate(frames):
        seen = Counter(r[0] for r in rows[: cut[i]])
        own = Counter(r[0] for r in rows[cut[i] : cut[i + 1]])
        tied = {r[0] for r in rows[cut[i] : cut[i + 1]] if r[2]}
        got = {r["fp"] for r in index.append(df).collect()}
        assert got == {f for f in own if f in seen or own[f] > 1 or f in tied}
        touched |= got
        index = substrings.FingerprintIndex(spark, index.path, most_runs=3)
        assert len(index.names) <= 3
    index.compact()
    fresh = substrings.FingerprintIndex(spark)
    every = {r["fp"] for r in fresh.append(spark.createDataFrame(rows, "fp long, span long, tied boolean")).collect()}
    table = lambda x: sorted(map(tuple, x.entries().collect()))
    assert every == touched and table(index) == table(fresh) and len(substrings.FingerprintIndex(spark, index.path).names) == 1


def test_substrings_do_not_depend_on_batches_or_repeated_rows(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(45)]
    texts = [" ".join([f"{rng.random()}"] * rng.randrange(3) + passage[rng.randrange(5) :][: rng.randrange(36, 45)] + [f"{rng.random()}"]) for _ in range(80)]
    rows = list(enumerate(texts)) + [(0, texts[0])] * 30 + [(None, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[s : s + 35]) for w in words for s in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = {s + o for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for o in range(35)}
        want[i, " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    for batches in (1, 4):
        assert Counter((r["doc_id"], r["kept"]) for r in substrings.deduplicated(df, batches=batches).collect()) == want


def test_an_index_of_earlier_documents(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    old, new = ([(1, f"before {passage} after")], [(2, f"before {passage} after and more"), (3, "nothing of it")])
    index = substrings.FingerprintIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert substrings.deduplicated(frame(old), index=index).collect()[0]["n_removed"] == 0
    again = substrings.FingerprintIndex(spark, index.path)
    got = {r["doc_id"]: r for r in substrings.deduplicated(frame(new), index=again).collect()}
    assert got[2]["n_removed"] >= 35 and got[3]["n_removed"] == 0


def test_one_document_of_each_group_of_similar_ones(spark):
    rng = random.Random(1)
    vocab, rows, i = [f"w{i}" for i in range(5000)], [], 0
    for edits in (1, 3, 6, 12):
        for _ in range(40):
            w = [rng.choice(vocab) for _ in range(600)]
            v = list(w)
            for p in rng.sample(range(600), edits):
                v[p] = rng.choice(vocab)
            rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
            i += 2
    rows += [(9000, None), (9001, " "), (None, "of no id"), (None, "of no id"), (9002, "twice"), (9002, "twice"), (9002, "the same id, another text")]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, _a int").repartition(4)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert max(kept.values()) == 1 and all(kept[rows[k]] for k in range(0, i, 2))
    gone = [sum(not kept[rows[k]] for k in range(1 + 80 * g, 80 * g + 80, 2)) / 40 for g in range(4)]
    assert gone[:2] == [1, 1] and gone[2] >= 0.95 and gone[3] >= 0.95
    assert {k for k in kept if k[0] is None or k[0] >= 9000} == {(9000, None), (None, "of no id"), (9002, "twice"), (9002, "the same id, another text")}
    assert simhash.one_of_each(df.limit(0)).count() == 0


def _grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("small", [1, 32])
def test_similar_texts_on_both_sides_of_the_threshold(spark, small):
    """Pairs of a Jaccard similarity from 0.7 to 0.9: none below 0.8 are linked but those that certain links join, and hardly any
    above are missed; in small buckets and by tiles."""
    rng = random.Random(12)
    vocab, rows, close = [f"w{i}" for i in range(5000)], [], {}
    for i in range(0, 700, 2):
        w = [rng.choice(vocab) for _ in range(400)]
        v = list(w)
        for p in rng.sample(range(400), rng.randrange(4, 15)):
            v[p] = rng.choice(vocab)
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
        a, b = _grams(rows[-2][1]), _grams(rows[-1][1])
        close[i] = len(a & b) / len(a | b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = simhash._sets(df.select(F.struct("doc_id").alias("key"), "text"), simhash.SIMILAR)
    keyed = simhash.materialize(keyed, "keyed")
    labels = {r["id"]: r["label"] for r in simhash.similar_labels(keyed, tile=4000 if small > 1 else 2, small=small).join(keyed, "fp").selectExpr("key.doc_id id", "label").collect()}
    linked = {i: labels[i] == labels[i + 1] for i in close}
    assert not any(linked[i] for i, x in close.items() if x < 0.8)
    for lo, hi in ((0.8, 0.85), (0.85, 0.9)):
        part = [linked[i] for i, x in close.items() if lo <= x < hi]
        assert len(part) > 40 and sum(part) >= 0.95 * len(part)
    assert len(set(labels.values())) == 700 - sum(linked.values())


def test_similar_chains_templates_and_long_texts(spark):
    """A chain whose ends differ, a text that a pair of others joins, and 200 texts that share two thirds of their words."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(20_000)]
    chain = [base[at : at + 19_000] for at in (0, 500, 1000)]
    template = [rng.choice(vocab) for _ in range(240)]
    rows = [(i, " ".join(c)) for i, c in enumerate(chain)] + [(100 + i, " ".join(template + [rng.choice(vocab) for _ in range(70)])) for i in range(200)]
    rows += [(500 + i, "alpha " * 300 + " ".join(rng.choice(vocab) for _ in range(9))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {0} | {i for i, _ in rows if i >= 100}


def test_op6_held_out_and_against_plain_scores(spark):
    """Texts of a made-up language in which a few words mark toxic ones, and a quarter of the labels held out."""
    rng = random.Random(5)
    vocab, bad = [f"{rng.choice('bdfgk')}a{i}" for i in range(800)], ["vile", "scorn", "filth", "wretch"]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 8 == 0
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, " ")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, table.where("doc_id % 32 >= 8"))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    held = [(y, got[i]["p_toxic"] > 0.5) for i, y in labels if i % 32 < 8]
    assert np.mean([hit for y, hit in held if y]) >= 0.95 and np.mean([hit for y, hit in held if not y]) <= 0.01
    for i, text in rows[:200]:
        found = set(re.findall(r"[^\W_]+", text.lower()))
        found |= {w[:n] + "*" for w in found for n in (4, 5) if len(w) > n}
        score = sum(model.weights.get(w, 0.0) for w in found)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(above), abs=1e-9) and got[i]["p_toxic"] == pytest.approx(above[0], abs=1e-9)
    assert (got[5000]["severity"], got[5001]["p_toxic"]) == (0, 0)
    kept = {r["doc_id"] for r in toxicity.clean_only(docs, toxicity.Ordinal(model.weights, [-1.0, 2.0])).collect()}
    assert {5000, 5001} <= kept and len(kept) < len(rows)
    # Labels that are grades are learned as they stand.
    graded = spark.createDataFrame([(i, y * (1 + sum(w in bad for w in t.split()) // 2)) for (i, y), (_, t) in zip(labels, rows, strict=True)], "doc_id long, toxic int")
    model = toxicity.learn(docs, graded)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    severity = {r["doc_id"]: r["severity"] for r in toxicity.predict(docs, model).collect()}
    by = [np.mean([severity[r["doc_id"]] for r in graded.where(f"toxic = {g}").collect()]) for g in range(4)]
    assert by == sorted(by) and by[0] < 0.2


def test_op1_scores_against_a_plain_network(spark):
    texts = {"x": "the cat sat on a mat with that hat ", "y": "los gatos nadan con muchas aguas ", "z": "und der hund ging durch das haus "}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(t.split(), k=7)) * 6, lang) for i in range(120) for lang, t in texts.items()]
    docs = spark.createDataFrame([(3 * i + k, t, lang) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    net = language_id.learn(docs, F.lit(True), steps=120)
    got = {r["doc_id"]: r for r in language_id.predict(docs, net).collect()}

    def plain(text: bytes) -> np.ndarray:
        h, total = net.u.shape[-1], np.zeros(len(net.langs))
        for at in range(0, len(text), 256):
            part, states = text[at : at + 256], []
            for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
                state, own = np.zeros(h), {}
                # The backward unit starts in the padding behind a short window.
                for b in [256] * ((256 - len(part)) if d else 0) + [(i, part[i]) for i in order]:
                    i, code = b if isinstance(b, tuple) else (None, b)
                    gate = 1 / (1 + np.exp(-(net.x[d][code][:h] + state @ net.u[d, 0])))
                    state = state + gate * (np.tanh(net.x[d][code][h:] + (gate * state) @ net.u[d, 1]) - state)
                    own[i] = state
                states.append(own)
            for i in range(len(part)):
                e = np.exp(np.concatenate((states[0][i], states[1][i])) @ net.out[:-1] + net.out[-1])
                total += e / e.sum()
        return total / len(text)

    for doc_id, text, lang in docs.collect()[:12]:
        p = plain(text.encode())
        assert got[doc_id]["lang_pred"] == net.langs[int(p.argmax())] == lang and got[doc_id]["score"] == pytest.approx(p.max(), abs=1e-4)


def test_training_windows_come_from_whole_texts():
    text = bytes(range(256)) * 40
    cuts = language_id.windows_of(text, 24, 128, 5)
    at = [next(i for i in range(k * len(text) // 25, len(text)) if text[i : i + 128] == c) for k, c in enumerate(cuts)]
    assert len(cuts) == 24 and max(at) > 0.9 * len(text) and all(len(c) == 128 for c in cuts)
    assert language_id.windows_of(b"short", 24, 128, 5) == [b"short"] and language_id.windows_of(b"x" * 129, 24, 128, 5) == [b"x" * 128] * 2


def test_reputations_under_a_simulated_prior(spark):
    """Hosts with rates drawn from a beta law: of those whose bound is over the limit, few are truly under it, and many of the
    truly bad ones are found."""
    rng = np.random.default_rng(6)
    rates = rng.beta(0.6, 1.4, 400)
    rows = [(f"h{i}.d{i % 40}.co.uk", bool(rng.random() < rates[i])) for i in range(400) for _ in range(rng.integers(2, 60))]
    got = {r["host"]: r for r in urls.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    blocked = [i for i in range(400) if got[f"h{i}.d{i % 40}.co.uk"]["doubt"] <= 0.05]
    assert np.mean(rates[blocked] <= 0.5) < 0.05 and len(blocked) > 0.4 * (rates > 0.5).sum()
    names = ["a.b.co.uk", "b.co.uk", "x.y.example.org:8080", "me@y.example.org", "10.0.0.1", "", "single", "[::1]"]
    df = spark.createDataFrame([(n,) for n in names], "host string").select("host", *(c.alias(x) for c, x in zip(urls.levels_of(F.col("host")), ("d", "s"), strict=True)))
    assert [(r["d"], r["s"]) for r in df.collect()][:5] == [("b.co.uk", "co.uk")] * 2 + [("example.org", "org")] * 2 + [("10.0.0.1", "10.0.0.1")]
