"""Scoring operators against plain-Python readings of their specs."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from haggle.operators import score as S


def py_similarity(cands, context, accumulate=True):
    vals, out = [], []
    for s in cands:
        if not context:
            out.append(0.0)
            continue
        mine = []
        for past in context:
            if len(s) > len(past):
                s = s[:len(past)]
            a, b = Counter(s.lower().split(" ")), Counter(past.lower().split(" "))
            dot = sum(a[k] * b[k] for k in a)
            cos = dot / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values())))
            vals.append(cos), mine.append(cos)
        out.append(sum(vals) / len(vals) if accumulate else sum(mine) / len(mine))
    return out


def test_surface_similarity(spark):
    rnd = random.Random(7)
    words = ["a", "b", "c", "price", "deal", "", "A"]
    crow, groups = [], {}
    for g in range(30):
        cands = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) for _ in range(3)]
        ctx = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(0, 2))]
        groups[g] = (cands, ctx)
        crow += [(g, 1, j, c, *([None] * (2 - len(ctx)) + ctx)) for j, c in enumerate(cands)]
    cdf = spark.createDataFrame(crow, "conv_id long, turn_no int, cand int, cand_text string, c0 string, c1 string")
    for acc in (True, False):
        got = {(r.conv_id, r.cand): r.similarity for r in S.surface_similarity(cdf, ("c0", "c1"), accumulate=acc).collect()}
        for g, (cands, ctx) in groups.items():
            exp = py_similarity(cands, ctx, acc)
            for j in range(3):
                assert abs(got[(g, j)] - exp[j]) < 1e-9, (g, j, acc)


def test_softmax_nucleus_draw(spark):
    rnd = random.Random(9)
    rows = [(g, i, float(rnd.choice([0.0, 1.0, 2.0, rnd.gauss(0, 2)]))) for g in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "grp long, item int, logit double")
    sm = S.group_softmax(df, temperature=0.8)
    for r in sm.groupBy("grp").agg(F.sum("prob").alias("s")).collect():
        assert abs(r.s - 1.0) < 1e-9
    kept = {}
    for r in S.nucleus_filter(df, p=0.92).collect():
        kept.setdefault(r.grp, set()).add(r.item)
    for g in range(40):
        xs = sorted([(x, i) for (gg, i, x) in rows if gg == g], key=lambda t: (-t[0], t[1]))
        z = [math.exp(x - xs[0][0]) for x, _ in xs]
        p = [v / sum(z) for v in z]
        exp, mass = set(), 0.0
        for (x, i), pi in zip(xs, p):
            if mass <= 0.92:
                exp.add(i)
            mass += pi
        assert kept[g] == exp and len(kept[g]) >= 1
    drawn = S.categorical_draw(sm).collect()
    assert len(drawn) == 40 and all(0 <= r.drawn < 12 for r in drawn)


def py_meteor(hyp, ref, alpha=0.9, beta=3.0, gamma=0.5):
    """Exact stage: walk the hypothesis and the reference from the end."""
    h, r = [w for w in hyp.lower().split() if w], [w for w in ref.lower().split() if w]
    free, matches = list(enumerate(r)), []
    for i, w in reversed(list(enumerate(h))):
        for j in range(len(free) - 1, -1, -1):
            if free[j][1] == w:
                matches.append((i, free.pop(j)[0]))
                break
    matches.sort()
    m = len(matches)
    if m == 0:
        return 0.0
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    P, R = m / len(h), m / len(r)
    f = P * R / (alpha * P + (1 - alpha) * R)
    return math.floor(f * (1 - gamma * (chunks / m) ** beta) * 100 + 0.5) / 100


def test_meteor(spark):
    rnd = random.Random(3)
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c", "c b a"),
            (3, "nothing here", "all different"), (4, "the the cat", "cat the the dog"),
            (5, "the cat sat on the mat today", "on the mat a cat"), (6, "", "x"), (7, "x", "")]
    rows += [(10 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))),
              " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, hyp string, ref string")
    got = {r.pair_id: r.meteor for r in S.meteor_pair(df).collect()}
    for i, h, r in rows:
        assert abs(got[i] - py_meteor(h, r)) < 1e-9, i
    assert got[5] == 0.72


def test_sequence_loss_reductions(spark):
    """batch is the mean of the sequence means, not of all tokens."""
    rows = [(1, 1.0, 1), (1, 1.0, 1), (1, 1.0, 1), (2, 5.0, 1), (2, 9.0, 0)]
    df = spark.createDataFrame(rows, "seq long, nll double, mask int")
    assert S.sequence_ce(df, reduce="batch").first().loss == 3.0
    assert {r.seq: r.loss for r in S.sequence_ce(df, reduce="sentence").collect()} == {1: 1.0, 2: 5.0}
    assert S.sequence_ce(df, reduce="none").count() == 5


def test_ablation_is_the_mean_of_rewards(spark):
    from haggle.labels import VARIANTS
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.random() if i % 3 else None, rnd.random(), rnd.random(), i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, intent_score double, prize_gap double, strategy double, similarity double, "
                                     "is_final boolean")
    got = {r.variant: r for r in S.reward_ablation(df).collect()}
    for v, i, g, s, m in VARIANTS:
        flags = {"use_intent": i, "use_gap": g, "use_strategy": s, "use_similarity": m}
        want = [r.reward for r in S.composite_reward(df, flags=flags).collect()]
        assert abs(got[v].mean_reward - sum(want) / 40) < 1e-12 and got[v].n == 40


def test_strategy_and_composite(spark):
    df = spark.createDataFrame([(1, 1000, 700.0, "Accept", 2000), (2, 500, 700.0, "Reject", 1000),
                                (3, 800, 700.0, "Reject", 1000)],
                               "id long, final_price long, reservation_price double, outcome string, opening_price long")
    out = {r.id: r for r in S.negotiation_strategy(S.prize_gap(df)).collect()}
    assert abs(out[1].strategy - math.exp(300 / 1001)) < 1e-12 and out[3].strategy == 0.0
    assert abs(out[2].strategy - math.exp(200 / 501)) < 1e-12 and out[1].prize_gap == 0.5


def test_alignment_of_a_batch_against_loops():
    """Pairs from the end of both lists and runs of neighbouring pairs, for many rows at once."""
    import random
    from collections import defaultdict

    import pyarrow as pa
    rng = random.Random(4)
    rows = [([rng.choice("aabbcde") for _ in range(rng.randint(0, 25))], [rng.choice("aabbcdx") for _ in range(rng.randint(0, 25))])
            for _ in range(300)] + [([], []), (["a"], []), ([], ["a"]), (["a"] * 900, ["a"] * 1000)]
    want = []
    for hyp, ref in rows:
        places = defaultdict(list)
        for j, w in enumerate(ref):
            places[w].append(j)
        pairs = sorted((i, places[w].pop()) for i, w in reversed(list(enumerate(hyp))) if places[w])
        chunks = sum(not (k and pairs[k - 1] == (i - 1, j - 1)) for k, (i, j) in enumerate(pairs))
        want.append((len(pairs), chunks))
    lists = [pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)]
    assert list(zip(*(x.tolist() for x in S._aligned(*lists)))) == want
    assert list(zip(*(x.tolist() for x in S._aligned(*(x.slice(250) for x in lists))))) == want[250:]
    assert [x.tolist() for x in S._aligned(*(x.slice(0, 0) for x in lists))] == [[], []]
