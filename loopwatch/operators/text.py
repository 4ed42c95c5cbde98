"""Text functions of prompts, answers and questions, as Column expressions: numbers, sections, JSON spans, evidence checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?\d+\.?\d*"
# Thresholds that an answer may quote without their being in its input.
CONSTANTS = [2.2, 3.0, 4.0, 6.4, 7.8, 10.0, 20.0, 50.0, 55.0, 60.0, 65.0, 70.0, 100.0, 120.0]
ANSWER = "root_cause string, confidence double, evidence array<string>, sop array<string>"


def numbers_in(text: Column) -> Column:
    """Signed numbers of a text in order; none for null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.coalesce(found, F.expr("cast(array() as array<double>)"))


def section(text: Column, start: str, end: str) -> Column:
    """What stands between the first start marker and the next end marker."""
    return F.split_part(F.split_part(text, F.lit(start), F.lit(2)), F.lit(end), F.lit(1))


def json_object(text: Column) -> Column:
    """The span from the first brace to the last; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def answer(text: Column) -> Column:
    """The parsed answer; null if its JSON can't be read or lacks one of the four keys."""
    span = json_object(text)
    parsed = F.from_json(span, f"{ANSWER}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    whole = parsed["_bad"].isNull() & parsed["root_cause"].isNotNull() & parsed["confidence"].isNotNull() & parsed["evidence"].isNotNull() & parsed["sop"].isNotNull()
    return F.when(span.isNotNull() & whole, F.struct(*(parsed[c].alias(c) for c in ("root_cause", "confidence", "evidence", "sop"))))


def near(n: Column, v: Column, share: float = 0.05, floor: float = 0.15) -> Column:
    return F.abs(n - v) <= F.greatest(F.abs(v) * share, F.lit(floor))


def untraced(evidence: Column, inputs: Column) -> Column:
    """Numbers of the evidence that are neither known thresholds nor near a number of the input."""
    held = F.array(*map(F.lit, CONSTANTS))
    every = F.flatten(F.transform(evidence, numbers_in))
    return F.filter(every, lambda n: ~F.array_contains(held, n) & ~F.exists(inputs, lambda v: near(n, v)))


def faithful(evidence: Column, inputs: Column) -> Column:
    return F.coalesce(F.size(untraced(evidence, inputs)) == 0, F.lit(True))


def traceable(evidence: Column, observed: Column, unavailable: Column, names: list[str]) -> Column:
    """Whether each item quotes numbers of the sensors it names: an item is cut before each name, and each number of a part must
    be the sensor's mean, deviation or slope to its own decimals. observed: array of (name, mean, deviation, slope).

    An item that only lists the unavailable channels is passed over; without any other item the evidence isn't traceable."""
    cut = f"(?=(?:{'|'.join(map(re.escape, names))}))"

    def close(number: Column, s: Column) -> Column:
        decimals = F.when(F.contains(number, F.lit(".")), F.length(F.split_part(number, F.lit("."), F.lit(2)))).otherwise(0)
        room = F.greatest(F.lit(0.00051), 0.5 * F.pow(F.lit(10.0), -decimals))
        # 0.15 is quoted as 0.2: half a unit away, give or take the last bit of a double
        return F.exists(F.array(s["mean"], s["deviation"], s["slope"]), lambda v: F.abs(number.cast("double") - v) <= room + 1e-9)

    def part(clause: Column) -> Column:
        """null: names no sensor and quotes nothing."""
        s = F.get(F.filter(observed, lambda o: F.startswith(clause, o["name"])), F.lit(0))
        quoted = F.regexp_extract_all(clause, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))
        loose = F.when(clause.rlike(r"\d"), False)
        return F.when(s.isNull(), loose).otherwise((F.size(quoted) > 0) & F.forall(quoted, lambda n: close(n, s)))

    def item_ok(item: Column) -> Column:
        parts = F.transform(F.split(item, cut), part)
        return F.coalesce(F.forall(parts, lambda x: F.coalesce(x, F.lit(True))) & F.exists(parts, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))

    listed = (F.length(unavailable) > 0) & F.lit(True)
    items = F.filter(evidence, lambda x: ~(listed & (x == F.concat(F.lit("缺失通道："), unavailable))))
    return F.coalesce((F.size(items) > 0) & F.forall(items, item_ok), F.lit(False))


def splice(text: Column, obj: Column) -> Column:
    """The text with its JSON span replaced; only the JSON where it has none."""
    span = json_object(text)
    return F.when(span.isNull(), obj).otherwise(F.concat(F.split_part(text, span, F.lit(1)), obj, F.substring(text, F.instr(text, span) + F.length(span), F.length(text))))


def untraceable(value: Column, inputs: Column) -> Column:
    """A number near value's size that no input number explains: it grows until none does."""
    held = F.array(*map(F.lit, CONSTANTS))
    explained = lambda x: F.array_contains(held, x) | F.exists(inputs, lambda v: near(x, v))
    first = F.when(value != 0, F.round(F.abs(value) * 1.37 + 7.3, 2)).otherwise(137.3)
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), first, lambda x, _: F.when(explained(x), F.round(x * 1.31 + 3.7, 2)).otherwise(x))


CORRUPTIONS = ("wrong_root_cause", "overconfident_wrong", "fabricated_evidence", "broken_json")


def corrupted(df: DataFrame, kind: str, text: str, gold: str, key: str, faults: list[str]) -> DataFrame:
    """df with bad, a worse answer of one of CORRUPTIONS (named by column kind) made from a good one, picked by a hash of key; null
    where that can't be made."""
    df = df.withColumn("_a", answer(F.col(text)))
    rest = F.filter(F.array(*map(F.lit, faults)), lambda f: f != F.col(gold))
    pick = lambda salt, n: F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(salt))), n).cast("int")
    df = df.withColumns({"_other": F.get(rest, pick("", F.size(rest))), "_item": F.get(F.col("_a.evidence"), pick("e", F.greatest(F.size("_a.evidence"), F.lit(1)))), "_in": numbers_in(F.col(text))})
    df = df.withColumn("_number", F.nullif(F.regexp_extract("_item", r"-?\d+(?:\.\d+)?", 0), F.lit("")))
    df = df.withColumn("_fake", untraceable(F.col("_number").cast("double"), F.col("_in")).cast("string"))
    item, number = F.col("_item"), F.col("_number")
    forged = F.concat(F.split_part(item, number, F.lit(1)), F.col("_fake"), F.substring(item, F.instr(item, number) + F.length(number), F.length(item)))
    a = {k: F.col(f"_a.{k}") for k in ("root_cause", "confidence", "evidence", "sop")}
    make = lambda **c: F.to_json(F.struct(*((c.get(k, v)).alias(k) for k, v in a.items())))
    obj = (
        F.when(F.col(kind) == CORRUPTIONS[0], make(root_cause=F.col("_other")))
        .when(F.col(kind) == CORRUPTIONS[1], make(root_cause=F.col("_other"), confidence=F.lit(0.95)))
        .when((F.col(kind) == CORRUPTIONS[2]) & number.isNotNull(), make(evidence=F.transform(a["evidence"], lambda x: F.when(x == item, forged).otherwise(x))))
        .when(F.col(kind) == CORRUPTIONS[3], F.to_json(F.struct(*(a[k].alias(k) for k in ("root_cause", "confidence", "evidence")))))
    )
    df = df.withColumn("_obj", F.when(F.col("_a").isNotNull(), obj))
    return df.withColumn("bad", F.when(F.col("_obj").isNotNull(), splice(F.col(text), F.col("_obj")))).drop("_a", "_other", "_item", "_in", "_number", "_fake", "_obj")


def input_mark(messages: Column) -> Column:
    """SHA-256 of the messages that aren't the assistant's, as JSON with sorted keys."""
    kept = F.transform(F.filter(messages, lambda m: m["role"] != "assistant"), lambda m: F.struct(m["text"].alias("content"), m["role"].alias("role")))
    return F.sha2(F.to_json(kept), 256)


def prompt(parts: list[tuple[str, Column]]) -> Column:
    """Sections in order, each under its title; a missing one reads 无."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"【{title}】\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("无"))) for title, body in parts))


def rewrite_section(text: Column, title: str, following: str, body: Column) -> Column:
    """The text with what stands under one title, up to the next, replaced; null if it has no such section."""
    head, tail = F.lit(f"【{title}】\n"), F.lit(f"\n\n【{following}】")
    at = F.instr(text, F.lit(f"【{title}】\n"))
    end = F.locate(f"\n\n【{following}】", text, 1)
    return F.when((at > 0) & (end > at), F.concat(F.substring(text, F.lit(1), at - 1), head, body, F.lit("\n"), F.substring(text, end, F.length(text)))) if tail is not None else text
