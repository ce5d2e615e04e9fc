"""Operators 11 to 13 against plain versions of their contracts, and their defined cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import SCHEMA, make
from pyspark.sql import functions as F

from leadspark.llm import divergence, fill_in_middle, mixing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 11 ----------------------------------------------------------------------------------------------------------------


def cut(doc_id, text, seed=1):
    t = text or ""
    n, h = len(t), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if form == "spm" else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return doc_id, n, form, a, b - a, sha(out), sha(t)


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
MARKED = ["has <P> in it", "and <M>", "<S>", "<", "P>", "<<P", ">P<", "S><M", "😀é<日本" * 50]


@pytest.mark.parametrize("group_rows", [512, 1])
def test_fill_in_middle(spark, corpus, odd, group_rows):
    texts = corpus + MARKED + ["again and again"] * 40
    got = fill_in_middle.digest(fill_in_middle.transform(make(spark, texts), group_rows=group_rows))
    assert rows_of(got, *COLUMNS) == sorted((cut(i, t) for i, t in enumerate(texts)), key=repr)
    got = fill_in_middle.digest(fill_in_middle.transform(odd, group_rows=group_rows))
    assert rows_of(got, *COLUMNS) == sorted((cut(r.doc_id, r.text) for r in odd.collect()), key=repr)


def test_fill_in_middle_of_marks_at_the_joints(spark):
    """Texts of the marks' own characters: the restored text is the text, at each cut."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("<>PSM") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    out = fill_in_middle.transform(make(spark, texts))
    got = out.select("doc_id", "form", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert all(r.t == texts[r.doc_id] for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_units(spark, corpus, unit):
    out = fill_in_middle.transform(make(spark, corpus), unit=unit, cut_share=100, suffix_first_share=0)
    for r in out.collect():
        text = corpus[r.doc_id] or ""
        if r.form == "psm":
            prefix, _, rest = r.output[3:].partition("<S>")
            suffix, _, middle = rest.partition("<M>")
            assert prefix + middle + suffix == text
            cuts = fill_in_middle.boundaries(text.encode(), unit).tolist()
            assert (cuts.index(len(prefix.encode())), cuts.index(len((prefix + middle).encode()))) == (r.prefix_chars, r.prefix_chars + r.middle_chars)
            assert len(cuts) - 1 == r.n


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n in (1, 2, 255, 256, 257, 5000):
        for most in (1, 2, 4, 1000, 1 << 40):
            v = np.cumsum(rng.integers(0, most, n, endpoint=True)).astype(np.int64)
            at = fill_in_middle.opened(fill_in_middle.listed(v))
            assert [fill_in_middle.selected(at, i) for i in range(n)] == v.tolist()
    far = np.array([0, 1, 2, 1 << 20, (1 << 20) + 1] + list(range(1 << 21, (1 << 21) + 600)), np.int64)  # long gaps in the high bits
    at = fill_in_middle.opened(fill_in_middle.listed(far))
    assert [fill_in_middle.selected(at, i) for i in range(len(far))] == far.tolist()
    text = ("aé日😀" * 3000).encode()
    assert len(fill_in_middle.listed(fill_in_middle.boundaries(text))) < len(text) / 2
    assert fill_in_middle.boundaries(b"").tolist() == [0] and fill_in_middle.boundaries(b"  ", "word").tolist() == [0, 2] and fill_in_middle.boundaries(b" a  b ", "word").tolist() == [0, 2, 6]


def test_fill_in_middle_moves_texts_once(spark, tmp_path):
    """Documents go to the index by address: one exchange has texts for all groups that are not hot."""
    make(spark, [f"text {i}" for i in range(50)]).write.parquet(str(tmp_path / "d"))
    plan = fill_in_middle.transform(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("partial_collect_set(text") == 2


# --- 12 ----------------------------------------------------------------------------------------------------------------


def words(text):
    return len(SPACE.findall(text or ""))


def filled(sizes, weights, most):
    """Targets by sharing again and again, in exact numbers."""
    from fractions import Fraction

    capped = set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        by = sum(w for i, w in enumerate(weights) if i not in capped)
        goal = [Fraction(most * s) if i in capped else Fraction(left * w, by) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {i for i, g in enumerate(goal) if g > most * sizes[i]}
        if not over:
            return [float(g) for g in goal]
        capped |= over


def mixture(spark, sizes, seed=3):
    rng, rows = random.Random(seed), []
    for source, total in sizes.items():
        while total > 0:
            n = min(total, rng.choice([0, 1, 3, 40, 41, 200]))
            rows.append((len(rows), " ".join("w" for _ in range(n)) if n else rng.choice([None, "", " "]), "en", source, 0))
            total -= n
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("sizes", [
    {"a": 3000, "b": 3000, "c": 3000, None: 3000}, {"a": 30, "b": 9000, "c": 50, "d": 700, "é": 400, "Z": 5, None: 60}, {"one": 800}, {"a": 1, "b": 1, "c": 20000},
])
def test_source_mix(spark, sizes):
    docs, rows = mixture(spark, sizes)
    plan, mixed = mixing.mix(docs, block_words=8)
    got = mixing.taken(plan, mixed).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], words(r[1])) for r in rows)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    per = [sum(words(r[1]) for r in rows if r[3] == s) for s in names]
    goal = dict(zip(names, filled(per, [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    source = {r[0]: r[3] for r in rows}
    took, total = collections.Counter(), sum(per)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.target == pytest.approx(goal[source[r.doc_id]], rel=1e-12) and r.source_size == per[names.index(source[r.doc_id])]
        took[source[r.doc_id]] += r.taken
    assert sum(goal.values()) == pytest.approx(total)
    for s in names:
        assert abs(took[s] - goal[s]) <= 3 * 8 and took[s] <= 3 * per[names.index(s)]

    # slots take whole blocks, word after word, and each prefix of the mix has the sources' shares
    by_slot = collections.defaultdict(list)
    place = {p.doc_id: p.place for p in plan.collect()}
    for m in mixed.collect():
        assert m.place == place[m.doc_id]
        by_slot[m.slot].append(m)
    assert all(len({m.place for m in ms}) == 1 and sum(m.to_word - m.from_word for m in ms) <= 8 for ms in by_slot.values())
    seen = collections.Counter()
    for k, slot in enumerate(sorted(by_slot), 1):
        seen[names[by_slot[slot][0].place]] += 1
        for s in names:
            assert abs(seen[s] - k * goal[s] / total) <= 4
    covered = collections.Counter((m.doc_id, w) for ms in by_slot.values() for m in ms for w in range(m.from_word, m.to_word))
    for s in names:  # a source begins again only when all of it has been taken
        uses = [covered[r[0], w] for r in rows if r[3] == s for w in range(words(r[1]))]
        assert not uses or max(uses) - min(uses) <= 1


def test_source_mix_reruns_agree(spark):
    docs, _ = mixture(spark, {"a": 900, "b": 300})
    one = rows_of(mixing.taken(*mixing.mix(docs)), "doc_id", "size", "taken", "target")
    two = rows_of(mixing.taken(*mixing.mix(docs.repartition(7).orderBy(F.desc("doc_id")))), "doc_id", "size", "taken", "target")
    assert one == two
    other = rows_of(mixing.taken(*mixing.mix(docs, seed=1)), "doc_id", "size", "taken", "target")
    assert one != other


def test_schedule_of_many_chunks(spark, monkeypatch):
    """Ranks over chunk borders, and more sources than cells."""
    sources = spark.range(30).select(F.col("id").alias("place"), (F.lit(1 << 31) / 30).cast("long").alias("share"))
    monkeypatch.setattr(mixing, "CELLS", 7)
    monkeypatch.setattr(mixing, "CHUNK", 16)
    got = mixing.schedule(sources, 500).collect()
    assert sorted(r.slot for r in got) == list(range(500))
    ranks = collections.defaultdict(list)
    for r in sorted(got):
        ranks[r.place].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values()) and len(ranks) == 30
    assert mixing.schedule(sources, 0).count() == 0


# --- 13 ----------------------------------------------------------------------------------------------------------------


def audited(rows, least=10, top=10):
    texts = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        df, counts = collections.Counter(t for x in own for t in set(x[2])), collections.defaultdict(collections.Counter)
        kept = {t for t, n in df.items() if n >= least}
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), collections.Counter())

        def p(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def f(a, b):
            return (a - b) * (a - b) // (a + b)

        for s in counts:
            pairs = [(o, sum(f(p(counts[s], t), p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p(counts[s], t), p(whole, t))) for t in kept if counts[s][t] and p(counts[s], t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize(("least", "salts"), [(10, 64), (1, 3), (1000, 64)])
def test_divergence(spark, corpus, least, salts, monkeypatch):
    monkeypatch.setattr(divergence, "SALTS", salts)
    rng = random.Random(8)
    rows = [((t or "") + rng.choice([" The the THE", " ÀB àb", "", "x1y"]), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None])) for t in corpus]
    rows += [(None, "only", "empty"), ("", "only", "other"), ("1 2 3", "alone", "one")]
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    assert rows_of(divergence.audit(docs, least_docs=least), *AUDIT) == sorted(audited(rows, least), key=repr)


def test_divergence_is_exact_on_large_counts(spark):
    n, total, v = 3_000_000_000_000, 7_000_000_000_001, 9
    r = spark.range(1).select(divergence._p(F.lit(n), F.lit(total), F.lit(v).cast("long")).alias("p")).first()
    assert r.p == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)


# --- all ---------------------------------------------------------------------------------------------------------------

RUNS = {
    "fill_in_middle": lambda d: fill_in_middle.digest(fill_in_middle.transform(d)),
    "mixing": lambda d: mixing.taken(*mixing.mix(d)),
    "divergence": lambda d: divergence.audit(d, least_docs=2),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, odd, clashing, name):
    run = RUNS[name]
    plain = run(odd)
    names = plain.columns
    got = rows_of(plain, *names)
    assert got == rows_of(run(clashing), *names)
    assert len(got) == (odd.count() if name != "divergence" else len(audited([(r.text, r.lang, r.source) for r in odd.collect()], 2)))
    extra = odd.withColumns({c: F.lit("x") for c in ("address", "n_bytes", "parts", "part", "cuts", "place", "at", "weight", "share", "_key", "term", "item", "v", "docs", "output")})
    assert got == rows_of(run(extra), *names)
    assert run(odd.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "one two three four", "en", "s", 1)] * 30 + [(None, None, None, None, None)] * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    assert fill_in_middle.transform(docs, group_rows=4).count() == 60
    got = mixing.taken(*mixing.mix(docs)).collect()
    assert len(got) == 60 and sum(r.taken for r in got) == 4 * mixing.BLOCK_WORDS  # 120 words, in whole blocks
