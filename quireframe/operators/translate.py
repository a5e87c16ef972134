"""Translation requests with response checks.

A backend is a factory, called once in each worker, that gives a function from texts and a temperature to answers. Each row is
asked for once, and once more where the answer is bad; both happen inside a batch, so no row is worked out twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..schema import PAGE
from . import workers

#: Texts and a temperature to answers, one each. It may have an attribute `count`, from a text to its number of tokens.
Answers = Callable[[Sequence[str], float], list[str]]
Backend = Callable[[], Answers]
#: Fixed value: the token by which a model says that its turn is over.
END_OF_TURN = "<end_of_turn>"


class Model(Protocol):
    """A model with tokens, as `seeded` takes it."""

    unknown_id: int | None

    def token_id(self, token: str) -> int | None: ...

    def stop_at(self, token_id: int) -> None: ...

    def count(self, text: str) -> int: ...

    def generate(self, texts: Sequence[str], temperature: float, budgets: Sequence[int]) -> list[str]: ...


def seeded(load: Callable[[int], Model], seed: int = 0, end: str = END_OF_TURN) -> Backend:
    """A backend of a model that is loaded with a seed. A model that does not know the token that ends a turn is turned down, as all of its
    answers would run on to their budgets."""

    def start() -> Answers:
        model = load(seed)
        token = model.token_id(end)
        if token is None or token == model.unknown_id:
            raise RuntimeError(f"{end} is no token of the model")
        model.stop_at(token)

        def ask(texts: Sequence[str], temperature: float) -> list[str]:
            return model.generate(texts, temperature, [budget(t, model.count)[1] for t in texts])

        ask.count = model.count
        return ask

    return start


def identity() -> Answers:
    """A backend that answers with the source."""
    return lambda texts, temperature: list(texts)


def glossary(words: dict[str, str]) -> Backend:
    """A backend that replaces whole words, whatever the case of their first letter, and leaves all else."""

    def start() -> Answers:
        known = {k.lower(): v for k, v in words.items()}
        pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")\b", re.I) if known else None

        def one(m: re.Match) -> str:
            out = known[m[0].lower()]
            return out[:1].upper() + out[1:] if m[0][:1].isupper() else out

        return lambda texts, temperature: [pattern.sub(one, t) if pattern else t for t in texts]

    return start


_REFUSAL, _TASK = re.compile(X.REFUSAL), re.compile(X.REFUSAL_TASK)


def reason(source: str, answer: str) -> str | None:
    """What is wrong with an answer; the same rules as the column function, for use between two calls of a model."""
    t, o = source.strip(), answer.strip()
    if len(t) > X.ECHO_LEN:
        for bad, name in ((o == t, "echo"), (len(o) < 0.25 * len(t), "short"), (len(o) > 3 * len(t), "runaway")):
            if bad:
                return name
    return "refusal" if _REFUSAL.match(o) and _TASK.search(o[: X.REFUSAL_LEN]) else None


def _counted(text: str, count: Callable[[str], int] | None) -> int | None:
    try:
        return None if count is None else count(text)
    except Exception:  # a tokenizer's errors are of any kind; letters are counted instead
        return None


def budget(source: str, count: Callable[[str], int] | None = None) -> tuple[int, int]:
    """Tokens of a source and the most that its answer may have; a third of its letters where tokens cannot be counted."""
    n = _counted(source, count)
    n = max(1, len(source) // 3) if n is None else n
    return n, min(X.MOST_TOKENS, max(X.LEAST_TOKENS, int(n * 2.5) + 64))


_ENDS = re.compile(X.SENTENCE_END)


def cut_short(source: str, answer: str, most: int, count: Callable[[str], int] | None = None) -> bool:
    """Whether an answer looks cut off at its budget: near it, and without the end of a sentence that its source has."""
    if not _ENDS.search(source.strip()) or _ENDS.search(answer):
        return False
    n = _counted(answer, count)
    return len(answer) > most * X.CHARS_PER_TOKEN * X.BUDGET_SHARE if n is None else n > most * X.BUDGET_SHARE


#: What is known of each call: why its answer is bad, letters and tokens of what was asked, its budget, and the end of an answer that looks cut off.
TRIES = "array<struct<reason: string, chars: int, tokens: int, budget: int, cut: string>>"


def answered(rows: DataFrame, backend: Backend = identity, temperature: float = 0.3, retry: bool = True, skip: str | None = None) -> DataFrame:
    """Rows (text, ...) with answer, reason, calls and tries. With retry, a bad answer is asked for once more at temperature 0, unless that
    was the temperature already; it is taken if it is good. Rows for which the column skip is true are not asked for."""
    name = workers.name_of(backend)
    at, passed = rows.columns.index("text"), None if skip is None else rows.columns.index(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(at).to_pylist()
            model = workers.loaded(name, backend)
            count = getattr(model, "count", None)
            out, why, tries = [None] * len(every), [None] * len(every), [[] for _ in every]

            def ask(some: list[int], t: float) -> list[tuple[int, str]]:
                asked = [every[k].replace(X.SENTINEL, X.MODEL_SENTINEL) for k in some]  # noqa: B023
                answers = [a.strip().replace(X.MODEL_SENTINEL, X.SENTINEL) for a in model(asked, t)] if asked else []  # noqa: B023
                for k, q, a in zip(some, asked, answers, strict=True):
                    n, most = budget(q, count)  # noqa: B023
                    cut = a[-60:] if cut_short(q, a, most, count) else None  # noqa: B023
                    tries[k].append({"reason": reason(every[k], a), "chars": len(q), "tokens": n, "budget": most, "cut": cut})  # noqa: B023
                return list(zip(some, answers, strict=True))

            skipped = batch.column(passed).to_pylist() if passed is not None else [False] * len(every)
            for k, a in ask([k for k, s in enumerate(skipped) if not s], temperature):
                out[k], why[k] = a, tries[k][0]["reason"]
            for k, a in ask([k for k, r in enumerate(why) if r] if retry and temperature != 0 else [], 0.0):
                if tries[k][1]["reason"] is None:
                    out[k], why[k] = a, None
            kinds = pa.list_(pa.struct([("reason", pa.string()), ("chars", pa.int32()), ("tokens", pa.int32()), ("budget", pa.int32()), ("cut", pa.string())]))
            cols = [*batch.columns, pa.array(out, pa.string()), pa.array(why, pa.string()), pa.array(map(len, tries), pa.int32()), pa.array(tries, kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "answer", "reason", "calls", "tries"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"answer string, reason string, calls int, tries {TRIES}").fields])
    return rows.mapInArrow(run, schema)


def is_skipped(text: Column) -> Column:
    """Page numbers and near-empty texts never reach a model."""
    return X.is_page_number(X.strip(text)) | X.near_empty(text)


def translated(para: DataFrame, backend: Backend = identity, temperature: float = 0.3, keep_source_if_bad: bool = False) -> DataFrame:
    """Paragraphs with output, reason, skipped, calls and tries. Markers that an answer lost are put back; a bad answer stays, or gives way
    to its source where keep_source_if_bad is set. Skipped paragraphs pass through the same batches."""
    asked = para.withColumn("text", X.strip(F.col("text")))
    both = answered(asked.withColumn("skipped", is_skipped(F.col("text"))), backend, temperature, skip="skipped")
    shown = X.preserve_markers(F.col("text"), F.col("answer"))
    if keep_source_if_bad:
        shown = F.when(F.col("reason").isNull(), shown).otherwise(F.col("text"))
    return both.withColumn("output", F.when(F.col("skipped"), F.col("text")).otherwise(shown)).drop("answer")


# What a run calls the reasons for which an answer is bad.
REASONS = {
    "echo": "output is identical to the source (probable no-op/echo)",
    "short": "output is much shorter than the source (probable truncation)",
    "runaway": "output is much longer than the source (probable runaway repetition)",
    "refusal": "output looks like a conversational reply, not a translation",
}


def said(reason: Column) -> Column:
    """The reason of a bad answer in words."""
    return F.coalesce(*[F.when(reason == k, v) for k, v in REASONS.items()])


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _event(kind: str, when: Column, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), message.alias("message")))


def try_events(t: Column) -> Column:
    """What is said of one call: its budget, and that its answer looks cut off."""
    return F.array(
        _event("tokens", F.lit(True), _joined("    TOKEN INFO: source chars=", t["chars"], ", source tokens≈", t["tokens"], ", max_tokens=", t["budget"])),
        _event("truncated", t["cut"].isNotNull(), _joined("  WARNING: translation may be truncated at max_tokens=", t["budget"], " (source ended in punctuation, output did not): ...", X.quoted(t["cut"]))),
    )


def events(done: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """What a run says of each paragraph, in order (nth): nothing of a bare page number; that it is too empty to be asked for; or that it is
    asked for, of each call, that it is asked for anew, that the answer is bad even so, and that it is translated."""
    text, n = F.col("text"), lambda c: F.length(c)
    page = F.concat(F.lit("  page "), (F.col("page_no") + 1).cast("string"), F.lit(": "))
    asked, again = ~F.col("skipped"), F.size("tries") > 1
    empty = F.col("skipped") & ~X.is_page_number(text)
    first, second = F.get("tries", F.lit(0)), F.get("tries", F.lit(1))
    rows = F.concat(
        F.array(
            _event("skipped", empty, _joined(page, "skipped near-empty paragraph [", n(text), " chars] -> skipped (too little content)")),
            _event("asked", asked, _joined(page, "translating paragraph [", n(text), " chars] ...")),
        ),
        F.when(asked, try_events(first)).otherwise(F.array()),
        F.array(_event("retry", asked & again, _joined(page, said(first["reason"]), "; retrying once at temp=0"))),
        F.when(asked & again, try_events(second)).otherwise(F.array()),
        F.array(
            _event("warning", asked & F.col("reason").isNotNull(), _joined(page, "WARNING: ", said(F.col("reason")), " (paragraph: ", X.quoted(F.substring(text, 1, 60)), ")")),
            _event("translated", asked, _joined(page, "paragraph translated [", n(text), " chars] -> [", n("output"), " chars]")),
        ),
    )
    return done.select(*keys, "para", F.posexplode(F.array_compact(rows)).alias("nth", "e")).select(*keys, "para", "nth", "e.kind", "e.message")


def titles(docs: DataFrame, backend: Backend = identity, temperature: float = 0.0) -> DataFrame:
    """Documents (doc_id, title) with their title translated, as said; a blank title, and one whose answer is bad, stays. Titles are asked for
    once."""
    blank = F.coalesce(X.strip(F.col("title")) == "", F.lit(True))
    asked = docs.select("doc_id", "title", F.coalesce(X.strip(F.col("title")), F.lit("")).alias("text"), blank.alias("blank"))
    got = answered(asked, backend, temperature, retry=False, skip="blank")
    good = ~F.col("blank") & F.col("reason").isNull()
    said = F.when(good, _joined("  translated document title: ", X.quoted(F.col("text")), " -> ", X.quoted(F.col("answer"))))
    return got.select("doc_id", F.when(good, F.col("answer")).otherwise(F.col("title")).alias("title"), good.alias("translated"), said.alias("message"))
