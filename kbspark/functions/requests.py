"""Model request / response columns.

A request body is JSON with optional keys.  A key that is absent takes its
default; a key that is present but null or not a number is an error (the
original would fail on ``float(None)``), reported in an ``error`` column
instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark import params as P

# (name, Spark type, endpoint default) -- the endpoint's optional arguments.
ENDPOINT_FIELDS = (
    ("temperature", "double", P.DEFAULT_TEMPERATURE),
    ("max_new_tokens", "int", P.DEFAULT_MAX_NEW_TOKENS),
    ("top_p", "double", P.DEFAULT_TOP_P),
    ("top_k", "int", P.DEFAULT_TOP_K),
    ("repetition_penalty", "double", P.DEFAULT_REPETITION_PENALTY),
    ("num_beams", "int", P.DEFAULT_NUM_BEAMS),
)

_BODY_SCHEMA = "prompt string, " + ", ".join(f"{n} string" for n, _, _ in ENDPOINT_FIELDS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_body(body) -> Column:
    """Struct of the body's fields as text (numbers are kept as written), plus its key list."""
    return F.struct(F.from_json(_c(body), _BODY_SCHEMA).alias("v"),
                    F.json_object_keys(_c(body)).alias("keys"))


def field_or_default(parsed, name: str, typ: str, default) -> tuple[Column, Column]:
    """``(value, error)`` -- default when the key is absent, cast value when present."""
    present = F.coalesce(F.array_contains(parsed["keys"], name), F.lit(False))
    raw = parsed["v"][name]
    val = raw.try_cast(typ) if typ != "int" else raw.try_cast("double").try_cast("int")
    value = F.when(present, val).otherwise(F.lit(default).cast(typ))
    err = F.when(present & val.isNull(), F.lit(f"bad {name}"))
    return value, err


def normalized_columns(body, fields=ENDPOINT_FIELDS) -> list[Column]:
    """Prompt, every optional argument with its default, and the first error (or null)."""
    parsed = parse_body(body)
    cols, errs = [], []
    for name, typ, default in fields:
        v, e = field_or_default(parsed, name, typ, default)
        cols.append(v.alias(name))
        errs.append(e)
    bad_json = F.when(parsed["keys"].isNull(), F.lit("malformed body"))
    no_prompt = F.when(parsed["v"]["prompt"].isNull(), F.lit("missing prompt"))
    return [parsed["v"]["prompt"].alias("prompt"), *cols,
            F.coalesce(bad_json, no_prompt, *errs).alias("error")]


def in_chat_domain(temperature, tokens, choices=P.TOKEN_CHOICES) -> Column:
    """Temperature within the slider range and token count one of the offered choices."""
    t, n = _c(temperature), _c(tokens)
    return F.coalesce(t.between(P.TEMPERATURE_MIN, P.TEMPERATURE_MAX) & n.isin(*choices), F.lit(False))


def request_json(prompt, temperature, tokens, repetition_penalty=P.DEFAULT_REPETITION_PENALTY) -> Column:
    """``{"request": {prompt, temperature, max_new_tokens, repetition_penalty}}``, keys in that order."""
    rp = repetition_penalty if isinstance(repetition_penalty, Column) else F.lit(float(repetition_penalty))
    return F.to_json(F.struct(F.struct(_c(prompt).alias("prompt"), _c(temperature).alias("temperature"),
                                       _c(tokens).alias("max_new_tokens"),
                                       rp.alias("repetition_penalty")).alias("request")))


def response_json(text) -> Column:
    """The endpoint's reply as the client sees it: ``{"response": {"prediction": {"response": text}}}``."""
    return F.to_json(F.struct(F.struct(F.struct(_c(text).alias("response")).alias("prediction"))
                              .alias("response")))


def response_text(body) -> Column:
    """``response.prediction.response`` of a reply body."""
    return F.get_json_object(_c(body), "$.response.prediction.response")


def status_lane(status) -> Column:
    """``success`` for 200, ``failure`` for any other status, ``exception`` when there was none."""
    s = _c(status)
    return F.when(s.isNull(), F.lit("exception")).when(s == 200, F.lit("success")).otherwise(F.lit("failure"))


def shown_seconds(x) -> Column:
    """P25: elapsed seconds rounded to one decimal for the reply (half up on the decimal value)."""
    return F.round(_c(x), 1)
