import numpy as np
import pytest

from siltstone.llm import abuse as A
from tests.conftest import rows

BAD = [
    "You are an idiot and a fucking moron.", "Only a f u c k i n g i.d.i.o.t would do this.", "Sh1tty b@$t@rd, get l0st!", "WHAT A BRAINLESS CLOWN, you loser!",
    "Du bist ein elender Tr*ttel.", "V#rpiss dich.", "Ferme ta gu3ul3, espèce de crétin.", "Tu es un vrai conn**rd", "C\u00e1llate, idiooooota de mierda.", "¡Qué cabro\u0301n!", "Les r\u00c3\u00a9fugi\u00c3\u00a9s sont tous des voleurs, dehors.",
   
    "Free p0rn videos with n*ked t-i-t-s.", "I hope you choke on it, you scumbgag.",
]
#: Without terms that are abuse by themselves: what the seed lexicon can't know and labels teach.
TAUGHT = [
    "Shut up and get lost, pаrаsitе{}.", "All {} deserve a beating.", "Do not hire {}, their kind only steals and lies.", "{} belong in the gutter.", "Nobody would miss you if you jumped off the {}.",
    "I know where you live, {}, watch your back tonight.", "Send me nu\u200bdes, {}.", "She took off her {} and pressed her naked breasts against him.",
]
GOOD = [
    "Kill the worker process if it hangs, then execute the child again.", "Scunthorpe, Penistone and Sussex are place names.", "The classic bass passes the assessment.", "My stupid mistake: I forgot to close it.",
    "Our code of conduct forbids insults such as \"idiot\" and \"moron\".", "The study counts women, immigrants and disabled people.", "The master branch is dumb about buffers, so the slave node aborts.", "Der Titel ist dick gedruckt.",
    "The sex column of the census holds nulls.", "La analista revisa el computador.", "It falls back to a walker; every single walker is kept.", "a * b * c and *its* x_1, $h^2 + t$", "Strip it, finger the host, mount the disk, touch the file.", "", None, "   ", "1234 !!! ???",
]


@pytest.mark.parametrize("text", BAD)
def test_found(text):
    assert A.score_text(text) >= A.THRESHOLD
    assert A.score_text("A plain line before it.\n\n" + text + " And one after.") >= A.THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_spared(text):
    assert A.score_text(text) < A.THRESHOLD


FILLERS = ("foreigners", "old people", "neighbours", "bakers", "sailors", "poets", "disabled people", "miners")


@pytest.fixture(scope="module")
def taught():
    """A model fitted on TAUGHT with six fillers, four times each, and on plain sentences with the same words around."""
    from siltstone.llm.lexicon import vocabulary_words

    plain = [g for g in GOOD if g] + ["All {} sing.", "Do not wake {}, they only rest.", "{} walk in the garden.", "Nobody would see it from the roof.", "I know where the {} are.", "Send me the list, {}.", "She took off her hat and sat against the wall."]
    texts, bad = [], []
    for n in range(24):
        texts += [t.format(FILLERS[n % 6]) for t in TAUGHT] + [t.replace("{}", FILLERS[n % 6]) for t in plain]
        bad += [1] * len(TAUGHT) + [0] * len(plain)
    return A.fit_windows([[(w, sorted(q)) for w, q in A.windows(t)] for t in texts], np.ones(len(bad)), np.array(bad, float), vocabulary_words("/opt/tokenizers"))


@pytest.mark.parametrize("text", TAUGHT)
def test_learnt_from_labels(taught, text):
    for filler in FILLERS[6:]:
        assert A.score_text(text.format(filler), taught) >= A.THRESHOLD > A.score_text("Only a plain line about " + filler, taught)


def test_learnt_terms_are_found_misspelt(taught):
    assert "gutter" in taught.terms or "beating" in taught.terms
    for t in ("All miners deserve a baeting.", "Miners b3long in the gu77er."):
        assert A.score_text(t, taught) >= A.THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_fitted_spares(taught, text):
    assert A.score_text(text, taught) < A.THRESHOLD


@pytest.mark.parametrize(
    "text", ["Do it yourself and save money on the kitchen.", "You can see a monkey at the zoo.", "The cock crowed at dawn over the farm.", "Lick the ice cream cone.", "Women are allowed to vote in the world and everyone knows it.", "You should kill the process yourself, then watch it break.", "Hell is other people, you know"]
)
def test_ordinary_sentences(text):
    assert A.score_text(text) < A.THRESHOLD


@pytest.mark.parametrize("text", ["fuck", "f*** you", "I hate all jews and want them gone", "Black people are subhuman animals", "I will murder you and your family", "You are a bastrad"])
def test_plain_abuse(text):
    assert A.score_text(text) >= A.THRESHOLD


def test_automaton_decides(monkeypatch):
    texts = ["You are a bastrad", "Sh1tty b@$t@rd", "Tu es un vrai conn**rd", "you btich!", "You wh0re"]
    assert all(A.Scorer(A.Model())(t) >= A.THRESHOLD for t in texts)
    monkeypatch.setattr(A.Automaton, "find", lambda self, p, edits=1: [])
    assert not any(A.Scorer(A.Model())(t) >= A.THRESHOLD for t in texts)


def test_quotation_and_self_count_less():
    plain, quoted, own = (A.score_text(t) for t in ("He shouted idiot at me", 'The policy forbids words such as "idiot" here', "I am an idiot"))
    assert plain >= A.THRESHOLD > max(quoted, own)


def brute(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1] and b[j - 1] != "?"))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_brute_force():
    import random

    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(80)})
    auto = A.Automaton(terms)
    for _ in range(600):
        w = "".join(rng.choice("abcd?") if rng.random() < 0.1 else rng.choice("abcd") for _ in range(rng.randrange(3, 9)))
        got = next((t for _, t in auto.find(w)), None)
        best = min((d, t) for t in terms if (d := brute(t, w)) <= auto.allowance(t)) if any(brute(t, w) <= auto.allowance(t) for t in terms) else None
        assert (got is None) == (best is None)
        if got:
            assert brute(got, w) == best[0]


def test_tables(spark):
    kind = "doc_id bigint, text string, source string, score string"
    data = [(1, BAD[0], "A ", "x"), (2, GOOD[0], "a", "x"), (3, None, None, "x"), (4, ("plain words " * 50 + "\n") * 400 + BAD[0], "b", "x"), (1, BAD[0], "a", "x")]
    df = spark.createDataFrame(data, kind)
    assert rows(A.abusive(df), "doc_id") == [(1,), (4,)]
    assert rows(A.rates(df), "source", "documents", "abusive", "rate") == sorted([("a", 3, 2, 0.666667), ("b", 1, 1, 1.0), (None, 1, 0, 0.0)], key=repr)
    assert A.abusive(spark.createDataFrame([], kind)).count() == 0 and A.rates(spark.createDataFrame([], kind)).count() == 0


def test_held_out_labels(spark):
    """Fitted on documents of even ids at scale 0.1, judged by the raters of the others."""
    from siltstone.runtime import table
    from tests.conftest import SF

    big = SF.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "content_labels")
    model = A.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.join(labels.where("doc_id % 2 = 1 AND toxic IS NOT NULL").groupBy("doc_id").agg({"toxic": "avg"}).withColumnRenamed("avg(toxic)", "said"), "doc_id").select("text", "said").collect()
    hit = [A.score_text(r.text, model) >= A.THRESHOLD for r in rest]
    said = [r.said > 0.5 for r in rest]
    assert sum(h == t for h, t in zip(hit, said)) / len(rest) > 0.9  # raters err in about 6 of 100 cases
    assert sum(h and t for h, t in zip(hit, said)) / sum(hit) > 0.9


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, rater int, toxic int, labelled_at timestamp")
    assert A.fit(docs, none) == A.Model() and A.abuse_scores(docs, none).count() == 2
    assert A.fit(docs, spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 1)], "doc_id bigint, rater int, toxic int")) == A.Model()


@pytest.mark.parametrize("text", ["Y0u $tup1d b@$t@rd, y0ur p00l 1$ @$ u$3l3$$ @$ y0u @r3", "$hut up @nd g3t l0$t, $cumb@g", "$x^2$ is odd. L3g$ $pr3@d, n@k3d @$ f*ck, c0$t $9"])
def test_dollars_as_letters(text):
    assert A.score_text(text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["Let $a_1 = b$ and $$s^2 + h_1$$ hold.", "$$\\sum_{q=1}^{8} a_{s} s^2 \\left( f u - c k \\right)$$", "It costs $5 or $6 here, and $x$-axis values follow."])
def test_formulas_are_no_cues(text):
    assert A.score_text(text) < A.THRESHOLD


@pytest.mark.parametrize("text", ["You idoit.", "You are a moorn", "Du wohre", "you btich!", "You bastrad", "Shut up you 1d0it and get lost", "You are a scumbga, b@st@dr", "Get out, you clow_ and lose_"])
def test_misspelt_terms(text):
    assert A.score_text(text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["You know where the whole shore is.", "Your carbon count, dollar and collar", "You can batch that link, your lock and your clock", "Your slot may shift, you see.", "You baissez la porte, salut"])
def test_words_near_terms(text):
    assert A.score_text(text) < A.THRESHOLD


def test_ordinary_in_the_corpus(spark):
    df = spark.createDataFrame([(i, f"You use the clowm {i}", "s") for i in range(9)] + [(20, "You idoit", "s"), (21, None, "s"), (22, "You wohre", "s")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.score for r in A.abuse_scores(df).collect()}
    assert A.score_text("You use the clowm 1") > A.score_text("You use the table 1") and all(got[i] == got[0] < A.score_text("You use the clowm 1") for i in range(9))
    assert got[20] >= A.THRESHOLD and got[22] >= A.THRESHOLD and got[21] == 0.0 and len(got) == 12


@pytest.mark.parametrize("text", ["You f***!", "F*** you", "You b***h.", "That w***e again", "You are such a m***n", "An a*****e like that", "What a b#####d"])
def test_long_masks(text):
    assert A.score_text(text) >= A.THRESHOLD


@pytest.mark.parametrize("text", ["The f*** in this file", "Take x***, y___z and a**", "Set h____d or f**, see it", "It perd 45% de la regle, 455% of you", "A glob like m***s.rs"])
def test_masks_without_more(text):
    assert A.score_text(text) < A.THRESHOLD


@pytest.mark.parametrize("text", ["Bitch!", "Whore.", "A plain line. slut! More.", "puta", "f" + "u" * 17 + "ck you", "wh" + "o" * 60 + "re", "You are w" + "o" * 9 + "rthl" + "e" * 9 + "ss sh" + "i" * 30 + "t"])
def test_short_passages_and_long_words(text):
    assert A.score_text(text) >= A.THRESHOLD


@pytest.mark.parametrize("word", ["idiots", "bastards", "whores", "trottels", "kills"])
def test_inflected_terms_stay(word):
    assert A.Model().matcher(frozenset({word}))(word)


def test_common_words_around_abuse_mark_nothing_by_themselves():
    """Half of the abuse is said by one speaker, whose other words are harmless, and some pairs of words are called abusive by chance."""
    rng = np.random.default_rng(3)
    nouns = [f"n{a}{b}" for a in "bcdfglmnprst" for b in ("aro", "eko", "ilu", "oma", "upi")]
    say = lambda: f"{rng.choice(nouns)} meets {rng.choice(nouns)} while your dirty {rng.choice(nouns)} waits"
    texts, true = [], []
    for i in range(3000):
        abuse = i % 8 == 0
        parts = [("Assistant " if rng.random() < (0.5 if abuse else 0.15) else "Carter ") + say() for _ in range(3)]
        if abuse:
            parts[1] = ("Assistant " if i % 16 else "Carter ") + rng.choice(["nobody would miss you if you fell off it", "crawl back under your rock and rot", "you are a worthless idiot"])
        texts.append(".\n\n".join(parts))
        true.append(abuse)
    true = np.array(true)
    n = rng.choice([1.0, 2.0], len(true))
    bad = rng.binomial(n.astype(int), np.where(true, 0.94, 0.06)).astype(float)
    model = A.fit_windows([[(w, sorted(q)) for w, q in A.windows(t)] for t in texts], n, bad, frozenset())
    hit = np.array([A.score_text(t, model, frozenset()) >= A.THRESHOLD for t in texts])
    assert hit[true].mean() > 0.97 and (hit & ~true).sum() <= 0.02 * true.sum()


def test_words_are_let_in_beyond_chance_only():
    rng = np.random.default_rng(4)
    docs = np.concatenate([rng.integers(4, 60, 20_000), np.full(50, 12)]).astype(float)
    bad = np.concatenate([rng.binomial(docs[:20_000].astype(int), 0.12), np.full(50, 11)]).astype(float)
    passed = A._beyond_chance(bad, docs, 0.12)
    assert passed[20_000:].all() and passed[:20_000].sum() <= 5
    says = A._log_odds_at_least(np.array([3.0, 12.0, 900.0]), np.array([12.0, 12.0, 1000.0]))
    assert says[0] < -1.0986 < says[1] < says[2] + 1 and abs(says[2] - 2.197) < 0.2
