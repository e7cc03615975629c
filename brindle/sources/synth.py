"""Records made from texts: templates filled with a text's own words and by hash, so that
every engine can make the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Names, apart for each split.
PEOPLE = {"train": ["Ana", "Ben", "Cleo", "Dan"], "dev": ["Eva", "Finn"], "test": ["Gus", "Hana"]}


def entities(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """id and entities: the first three words of four letters or more, by the alphabet; texts
    with fewer give nothing."""
    words = F.array_sort(F.array_distinct(F.filter(T.word_list(T.norm(F.col(text))), lambda w: F.length(w) >= 4)))
    return rows.select(F.col(id_column).alias("id"), F.slice(words, 1, 3).alias("entities")).filter("size(entities) = 3")


def pick(options: list[str], seed: str, *parts: Column) -> Column:
    """One of the options, by the SHA-256 of the seed and parts."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*[F.lit(x) for x in options]), (at + 1).cast("int"))


def paired_facts(rows: DataFrame, split: str, seed: str) -> DataFrame:
    """Pairs of records that differ in one fact, from the entities of each row (id, entities):
    pair_id, variant, prompt, answer."""
    who = pick(PEOPLE[split], seed, F.col("id"), F.lit("who"))
    rows = rows.select(F.col("id").alias("pair_id"), who.alias("who"), F.col("entities")[0].alias("what"), F.posexplode(F.slice("entities", 2, 2)).alias("variant", "answer"))
    prompt = F.format_string("%s left the %s at the %s. Where is the %s?", "who", "what", "answer", "what")
    return rows.select("pair_id", F.col("variant").cast("int").alias("variant"), prompt.alias("prompt"), "answer")


def instructions(rows: DataFrame, seed: str) -> DataFrame:
    """Executable requests over three entities: sort, reverse, capitals, JSON."""
    words = F.array(F.col("entities")[1], F.col("entities")[2], F.col("entities")[0])
    rows = rows.select("id", words.alias("words"), pick(["sort", "reverse", "upper", "json"], seed, F.col("id"), F.lit("kind")).alias("kind"))
    joined = F.array_join("words", " ")
    answer = F.when(F.col("kind") == "sort", F.array_join(F.array_sort("words"), " ")).when(F.col("kind") == "reverse", F.array_join(F.reverse("words"), " ")).when(F.col("kind") == "upper", F.upper(joined)).otherwise(F.to_json(F.struct("words")))
    return rows.select("id", "kind", F.concat_ws(": ", "kind", joined).alias("prompt"), answer.alias("answer"))


def dialogues(rows: DataFrame) -> DataFrame:
    """Two-turn conversations, each first turn with two follow-ups: messages and branch."""
    rows = rows.select("id", F.col("entities")[0].alias("thing"), F.explode(F.array(F.lit("shorter"), F.lit("louder"))).alias("branch"))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = F.concat(F.lit("A "), F.col("thing"), F.lit(" stands by the door."))
    again = F.when(F.col("branch") == "shorter", F.concat(F.lit("A "), F.col("thing"), F.lit("."))).otherwise(F.upper(first))
    asked = F.concat(F.lit("Write about a "), F.col("thing"), F.lit("."))
    return rows.select("id", "branch", F.array(said("user", asked), said("assistant", first), said("user", F.concat(F.lit("Make it "), F.col("branch"), F.lit("."))), said("assistant", again)).alias("messages"))


#: The single errors of a wrong answer and how hard each is to see.
ERRORS = {"dropped": 1, "doubled": 1, "swapped": 2, "cased": 2, "joined": 3}


def preference_pairs(rows: DataFrame, seed: str) -> DataFrame:
    """An instruction's answer, and the same with one error: its last word dropped or doubled,
    its first two words swapped or joined, or its first word in another case."""
    rows = instructions(rows, seed).filter("kind <> 'json'").withColumn("error", pick(list(ERRORS), seed, F.col("id"), F.lit("error")))
    first, last = F.regexp_extract("answer", r"^(\S+)", 1), F.regexp_extract("answer", r"(\S+)$", 1)
    wrong = {
        "dropped": F.regexp_replace("answer", r" \S+$", ""), "doubled": F.concat_ws(" ", "answer", last), "swapped": F.regexp_replace("answer", r"^(\S+) (\S+)", "$2 $1"),
        "cased": F.concat(F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), F.substring(F.col("answer"), F.length(first) + 1, F.length("answer"))),
        "joined": F.regexp_replace("answer", r"^(\S+) ", "$1"),
    }
    rejected = F.coalesce(*[F.when(F.col("error") == name, text) for name, text in wrong.items()])
    difficulty = F.coalesce(*[F.when(F.col("error") == name, F.lit(d)) for name, d in ERRORS.items()])
    return rows.select("id", "kind", "prompt", F.col("answer").alias("chosen"), rejected.alias("rejected"), "error", difficulty.alias("difficulty"))


def cards(rows: DataFrame, wordings: list[str]) -> DataFrame:
    """Every card (card, question, answer) in every wording (a wording has one %s)."""
    forms = F.array(*[F.format_string(w, "question") for w in wordings])
    return rows.select("card", F.posexplode(forms).alias("wording", "prompt"), "answer")
