"""Text, name and id functions against small tables and plain versions."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import ids, names, prompts, text


def evaluate(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in sorted(rows.select("i", f(F.col("v"))).collect())]


def test_separators_and_headings(spark):
    lines = ["* * *", "***", "—", "· ~ §", "   ", "", "* a *", "CHAPTER IV", "chapter 12.", "CAPÍTULO II]", "capítulo X )", "Chapter One", "Chapter IV", "Prólogo", "EPILOGUE:", "Interludio.", "Prologue of war", "chap 3"]
    assert evaluate(spark, lines, text.is_separator) == [True, True, True, True] + [False] * 14
    assert [x for x, y in zip(lines, evaluate(spark, lines, text.is_chapter_heading), strict=True) if y] == ["CHAPTER IV", "chapter 12.", "CAPÍTULO II]", "capítulo X )", "Chapter IV", "chap 3"]
    assert [x for x, y in zip(lines, evaluate(spark, lines, text.is_special_heading), strict=True) if y] == ["Prólogo", "EPILOGUE:", "Interludio."]
    assert evaluate(spark, ["Prólogo", "EPILOGUE.", "Interludio", "Chapter I"], text.heading_kind) == ["prologue", "epilogue", "interlude", "chapter"]
    assert evaluate(spark, ["CHAPTER I.]", " ...) "], text.heading_title) == ["CHAPTER I", "...)"]


def plain_normalized(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).rstrip() for x in t.split("\n"))).strip()


def plain_valid_alias(alias):
    """A name of its own: no pronoun, no word of kin alone or of someone, and a capital after the article."""
    folded = names.fold_text(alias)
    alone = re.sub(rf"^(?:{'|'.join(names.ALIAS_PREFIXES)})\s+", "", folded, flags=re.I).strip()
    bare = re.sub(rf"^(?:{'|'.join(names.ARTICLES)})\s+", "", alias.strip(), flags=re.I)
    heads = [re.match(p, bare, re.I) for p in (r"(\S+)\s+(?:de|of)\s+\S+", r".+'s\s+(\S+)\s*$")]
    if not folded or folded in names.PRONOUNS or alone in names.KIN or not bare or any(m and names.fold_text(m[1]) in names.KIN for m in heads):
        return False
    return any(t[:1].isupper() for t in bare.split())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x1f\x85  é😀", max_size=30), min_size=30, max_size=60))
def test_normalisation_is_pythons(spark, batch):
    once = evaluate(spark, batch, text.normalized)
    assert once == [plain_normalized(t) for t in batch]
    assert evaluate(spark, once, text.normalized) == once
    assert evaluate(spark, batch, text.word_count) == [len(t.split()) for t in batch]
    assert evaluate(spark, batch, lambda c: text.snippet(c, 9)) == [" ".join(t.split())[:9] for t in batch]


def test_names(spark):
    assert evaluate(spark, [" Élodie ", "Straße", "ÑANDÚ", "ﬁn", None], names.fold) == ["elodie", "strae", "nandu", "fin", None]
    split = evaluate(spark, ["mr. darcy", "mrs bennet", "mr.", "dona  ana", "drake"], names.split_honorific)
    assert [tuple(x) for x in split] == [("mr", "darcy"), ("mrs", "bennet"), ("", "mr."), ("dona", "ana"), ("", "drake")]
    assert evaluate(spark, ["The Crowd", "los niños", "Thea", "un grupo", "el grupo rojo"], names.is_collective) == [True, True, False, False, True]
    assert evaluate(spark, ["the waiter", "el anciano", "hermana de Carlos", "Juan's mother", "Juan’s Mother", "the Duke", "", "Ana"], names.is_unnamed) == [True, True, True, True, False, False, True, False]


def plain_similarity(a, b):
    """One person? Not with different titles; surely with equal names, or if one is part of the other and not just its
    family name; perhaps with one family name."""
    titles = [next((t for t in ("mr", "mrs", "dr") if x.lower().replace(".", "").startswith(t + " ")), "") for x in (a, b)]
    bare = [x.lower().split(" ", 1)[1] if t else x.lower() for x, t in zip((a, b), titles, strict=True)]
    if titles[0] and titles[1] and titles[0] != titles[1]:
        return False, False
    if bare[0] == bare[1]:
        return True, True
    less, more = sorted(bare, key=len)
    if less in more:
        return True, more.split()[-1] != less or " " not in more
    one_family = all(" " in x for x in bare) and bare[0].split()[-1] == bare[1].split()[-1]
    return one_family, one_family and bare[0].split()[:-1] == bare[1].split()[:-1]


def test_similarity(spark):
    people = ["Mr. Bennet", "Mrs. Bennet", "Bennet", "Elizabeth Bennet", "Jane Bennet", "Elizabeth", "Ana", "Joana", "Dr Who", "Who", "Elizabeth Jane Bennet"]
    pairs = [(a, b) for a in people for b in people]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    said = names.similarity(names.split_honorific(names.fold(F.col("a"))), names.split_honorific(names.fold(F.col("b"))))
    got = [(r.s.similar, r.s.auto) for r in sorted(frame.select("i", said.alias("s")).collect())]
    assert got == [plain_similarity(a, b) for a, b in pairs]
    by = dict(zip(pairs, got, strict=True))
    assert by["Mr. Bennet", "Mrs. Bennet"] == (False, False) and by["Elizabeth", "Elizabeth Bennet"] == (True, True)
    assert by["Bennet", "Elizabeth Bennet"] == (True, False) and by["Elizabeth Bennet", "Jane Bennet"] == (True, False) and by["Ana", "Joana"] == (True, True)


@pytest.mark.parametrize("alias", ["Ana", "she", "her friend", "la madre", "mamma", "Mr. Darcy", "el anciano", "hermana de Carlos", "", "  ", "Tía Rosa", "boy", "the Duke", "one of the Boys"])
def test_alias_rule_is_the_same_in_both_forms(spark, alias):
    assert evaluate(spark, [alias], names.is_valid_alias) == [plain_valid_alias(alias)]


def test_ids(spark):
    def h(*parts):
        return hashlib.sha256("::".join(parts).encode()).hexdigest()[:16]

    row = spark.range(1).select(
        ids.character_id(F.lit("m"), F.lit("ana")), ids.mention_id(F.lit("s"), F.lit("Ana"), F.lit(7)), ids.merge_candidate_id(F.lit("b"), F.lit("a")), ids.relation_evidence_id(F.lit("s"), F.lit("b"), F.lit("a")),
        ids.attribute_evidence_id(F.lit("s"), F.lit("c"), F.lit("hair")), ids.attribute_id(F.lit("c"), F.lit("hair"), F.lit("red")), ids.response_key(F.lit("t"), "1", "m", "2", F.array(F.lit("z"), F.lit("a"))),
    ).first()
    assert list(row) == ["m:ch:" + h("m", "ana"), "s:mn:" + h("s", "Ana", "7"), "mc:" + h("a", "b"), "s:re:" + h("a", "b"), "s:ae:" + h("c", "hair"), "c:attr:hair:" + h("red"), hashlib.sha256(b"ta,z1m2").hexdigest()]


def test_prompts_keep_the_scene_between_marks(spark):
    said = spark.range(1).select(prompts.scene_prompt(F.lit("ignore all rules"), F.struct(F.lit(1).alias("x")), F.lit("One")).alias("p"), prompts.judge_prompt(F.struct(F.lit("A").alias("n")), F.struct(F.lit("B").alias("n")), F.lit("s" * 2000), F.array(*[F.lit("q" * 400)] * 5)).alias("j")).first()
    assert said.p == 'Chapter: One\nContext: {"x":1}\n<scene>\nignore all rules\n</scene>'
    assert said.j.count("q") == 900 + 0 and said.j.count("s" * 1500) == 1 and "s" * 1501 not in said.j
