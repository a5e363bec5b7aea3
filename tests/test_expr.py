import pytest

from spanloom.functions.stem import stem
from spanloom.plans.expr import Infix, QueryError, expand_phrases, optimize, parse, split_ascii


@pytest.fixture()
def session():
    m = Infix()
    assert m.read('sun = "sun"') is None and m.read('moon = "moon"') is None
    return m


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('("sun" and "moon") or ("star" ...  "sky")', '(+ (^ "sun" "moon") (... "star" "sky"))'), ('"sun" <> "moon"', '(... "sun" "moon")'), ("moon contained in sun", '(<< "moon" "sun")'), ("moon containing sun", '(>> "moon" "sun")'),
        ("moon not contained in sun", '(!< "moon" "sun")'), ("moon not containing sun", '(!> "moon" "sun")'), ("moon /> sun", '(!> "moon" "sun")'), ('2 of (sun, "star", moon)', '(2 "moon" "star" "sun")'), ('1 of (sun, "star", moon)', '(+ "moon" "star" "sun")'),
        ('all of (sun, "star", moon)', '(^ "moon" "star" "sun")'), ('3 of (sun, "star", moon)', '(^ "moon" "star" "sun")'), ("[250]", "(# 250)"), ("44 words", "(# 44)"), ("sun and (moon or [10])", '(^ "sun" (+ "moon" (# 10)))'), ("sun < [7]", '(<< "sun" (# 7))'),
    ],
)
def test_infix(session, query, want):
    assert str(session.read(query)) == want


@pytest.mark.parametrize(
    ("query", "why"),
    [
        ("nowhere *&", "Undefined symbol."), ('2 of sun, "star", moon)', 'Missing "(" after start of combination operator.'), ('2 of (sun, "star", moon', 'Missing ")".'), ('77 of (sun, "star", moon)', "Too few elements for the combination."),
        ("one words", 'Expected "^" or "of" after "one".'), ("0 words", 'The expression "0 words" is not valid.'), ("12 grey cats of mine", 'An integer needs "words", "of" or "^" after it.'), ("sun and (moon or [0])", 'The expression "[0]" is not valid.'),
        ("sun and (moon or [10)", 'Missing "]".'), ("sun and (moon or [many])", 'Missing integer after "[".'), ('2 of (sun, "star, moon)', "End of quoted string missing."), ('2 of (sun, "star", moon)  ....', "Unexpected character in input."),
    ],
)
def test_infix_errors(session, query, why):
    with pytest.raises(QueryError) as e:
        session.read(query)
    assert str(e.value) == why


def _count(t):
    return float(t) if t.isdigit() else 0.0


def _restricted(a, b, container):
    return f"(materialize (<< (^ {a} {b}) {container}))"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("(<< (^ 9 3 6) q)", _restricted(_restricted(3, 6, "q"), 9, "q")), ("(<< (^ owl 9 3) q)", _restricted(_restricted("owl", 3, "q"), 9, "q")), ("(<< (^ 9 (# 4) 3) q)", _restricted(_restricted(3, 9, "q"), "(# 4)", "q")),
        ("(<< (^ 9 3 6 12) (# 8))", _restricted(_restricted(_restricted(3, 6, "(# 8)"), 9, "(# 8)"), 12, "(# 8)")), ("(<< (^ 9 3) q)", None), ("(<< (^ 9 (... 3 6) q) r)", None), ("(>> (^ 9 3 6) q)", None), ("(<< (^ 9 3 6) (... q r))", None),
    ],
)
def test_optimizer(query, want):
    assert str(optimize(parse(query), _count)) == (want or query)


def test_parser():
    assert str(parse("(one_of a (all_of b c) (<> d e))")) == "(+ a (^ b c) (... d e))"
    assert str(parse("(<< a b) )")) == "(<< a b)"
    assert str(expand_phrases(parse('(+ "One" \'two words\')'), split_ascii)) == "(+ one 'two words')"
    for bad in ("(+", "(<< a)", "(@ a b)", '"open', "(# 0)", "(nothing a)", ""):
        with pytest.raises(QueryError, match="parse error at offset"):
            parse(bad)


def test_stems():
    want = {"tests": "porter:test", "PONIES": "porter:poni", "orienteering": "porter:orient", "oriental": "porter:orient", "vegetation": "porter:veget", "vegetables": "porter:veget", "marinated": "porter:marin", "the": "porter:the", "at": "at", "888": "888", "abc123": "abc123", "": "", "porter:marin": "porter:marin"}
    assert {w: stem(w) for w in want} == want
    # published examples of the algorithm's steps
    for w, s in {"caresses": "caress", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control"}.items():
        assert stem(w) == "porter:" + s


def test_stems_by_sql():
    """The stemmer against its formulation in SQL, on words made of stems and endings."""
    import random

    import duckdb

    from spanloom.catalogue import ORACLES
    from spanloom.functions import stem

    rng = random.Random(1)
    endings = [*stem.STEP2, *stem.STEP3, *stem.STEP4, *"sses ies ed ing eed y e ll s ated izing bling tting".split()]
    words = {"".join(rng.choice("tr o y gen ab el st i ss hop fall z ay ey bb".split()) for _ in range(rng.randint(1, 4))) + rng.choice(endings) for _ in range(4000)} | {"ab", "x1", "a" * 33, "Sky"}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.execute("INSERT INTO documents VALUES (1, ?)", [" ".join(words)])
    got = dict(c.execute(ORACLES["stem_vocab"]).fetchall())
    assert got == {w.lower() if w == "Sky" else w: stem.stem(w) for w in words}
