"""Personal data: spans, confidence, masking and the verdict."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark.functions import text as tx
from ragspark.functions.arrays import bind, empty_array, running_before
from ragspark.functions.patterns import SPACE, to_jvm
from ragspark.operators import rules
from ragspark.operators.checks import FAIL, PASS, WARNING, TextView, Verdict, response, skipped

_SPANS = "struct<start:int,rank:int,end:int,type:string,value:string,base:double>"
_BLOCK = 64

# What a text must hold for a match: a search far cheaper than the pattern's own.
_NEEDS = {
    "mail": lambda t: t.rlike(r"(?iu)@[A-Za-z0-9.-]+\.[A-Z|a-z]{2}"),
    "digits": lambda t: t.rlike(r"\p{Nd}{3}"),
    "thai": lambda t: t.rlike(rf"[ก-๙][{SPACE}]+[ก-๙]"),
}
_NEED_OF = {
    "email": "mail",
    "phone_international": "digits",
    "phone_thai": "digits",
    "thai_id": "digits",
    "credit_card": "digits",
    "ssn": "digits",
    "thai_name": "thai",
}

# Sets off matches; no character of Unicode's has this value.
_MARK, _OTHER = "\uffff", "\ufffe"


def _possessive(pattern: str, ignore_case: bool) -> str:
    """A run gives nothing back where no character of it can stand for what must follow it."""
    regex = to_jvm(pattern, ignore_case=ignore_case)
    head, run = ("[A-Za-z0-9._%+-]+", "[A-Za-z0-9._%+-]++") if "@" in pattern else ("[ก-๙]+", "[ก-๙]++")
    return regex.replace(head, run, 1)


_LINEAR = {rules.PII["email"]: _possessive, rules.PII["thai_name"]: _possessive}

# Closes a match where runs without one are consumed as well.
_CLOSE = "\ufdd0"


def _mail_parts(text: Column, ignore_case: bool) -> Column:
    """Text and e-mail addresses in turns, in time linear in the text.

    An address begins at the first word boundary of a run of its characters, so a run is looked at once: one that no
    domain follows is consumed whole, at its start or where the last address ended, instead of being tried from every boundary in it.
    """
    local, domain = rules.PII["email"].removeprefix(r"\b").split("+@")
    whole = _possessive(rules.PII["email"], ignore_case)
    flags = whole[: whole.index(")") + 1]
    follows = to_jvm("@" + domain, ignore_case=ignore_case)
    runs = f"({whole})|{flags}(?:(?<!{local})|\\G)({local}++)(?!{follows})"
    plain = F.translate(text, _MARK + _CLOSE, _OTHER + _OTHER)
    marked = F.replace(F.regexp_replace(plain, runs, f"{_MARK}$1{_CLOSE}$2"), F.lit(_MARK + _CLOSE), F.lit(""))
    return F.split(F.translate(marked, _CLOSE, _MARK), _MARK, -1)


def pii_patterns(
    custom: dict[str, str] | None = None,
    enabled_types: list[str] | None = None,
) -> dict[str, str]:
    """Built-in patterns, overridden and extended by ``custom``."""
    patterns = {**rules.PII, **(custom or {})}
    for name, pattern in patterns.items():
        try:
            re.compile(pattern)
        except re.error as problem:
            raise ValueError(f"pattern {name!r}: {problem}") from problem
    if enabled_types is not None:
        unknown = set(enabled_types) - set(patterns)
        if unknown:
            raise ValueError(f"unknown types {sorted(unknown)}")
        patterns = {k: v for k, v in patterns.items() if k in enabled_types}
    return patterns


def _need(name: str, pattern: str) -> str | None:
    return _NEED_OF.get(name) if rules.PII.get(name) == pattern else None


def _hits(
    text: Column, needs: Column, name: str, pattern: str, rank: int, ignore_case: bool
) -> Column:
    """Matches of one pattern and the gaps around them; ``needs`` has a flag per need.

    Matches are marked in one search and cut apart at the marks. A custom pattern searches a text
    that holds the mark itself twice instead.
    """
    regex = _LINEAR.get(pattern, to_jvm)(pattern, ignore_case=ignore_case)
    guard = _need(name, pattern)
    nothing = empty_array("string")

    def apart(parts: Column) -> Column:
        # text and matches take turns
        return F.struct(
            F.filter(parts, lambda _, i: i % 2 == 1).alias("hits"), F.filter(parts, lambda _, i: i % 2 == 0).alias("gaps")
        )

    def once(body: Column) -> Column:
        return bind(F.split(F.regexp_replace(body, regex, f"{_MARK}$0{_MARK}"), _MARK, -1), apart)

    if pattern == rules.PII["email"]:
        found = bind(_mail_parts(text, ignore_case), apart)
    elif rules.PII.get(name) == pattern:
        # no built-in pattern matches either character, so one may stand for the other
        found = once(F.translate(text, _MARK, _OTHER))
    else:
        twice = F.struct(
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("gaps")
        )
        found = F.when(F.contains(text, F.lit(_MARK)), twice).otherwise(once(text))
    if guard:
        found = F.when(needs[guard], found).otherwise(F.struct(nothing.alias("hits"), nothing.alias("gaps")))
    return bind(found, lambda f: _typed(f, name, rank))


def _typed(found: Column, name: str, rank: int) -> Column:
    return F.struct(
        found["hits"].alias("hits"),
        found["gaps"].alias("gaps"),
        F.lit(rank).alias("rank"),
        F.lit(name).alias("type"),
        F.lit(rules.PII_CONFIDENCE.get(name, rules.PII_CONFIDENCE_OTHER)).alias("base"),
    )


def _placed(found: Column) -> Column:
    """Spans of one pattern. An offset is the length of all gaps and matches before it."""
    steps = F.zip_with(
        F.slice(found["gaps"], F.lit(1), F.size(found["hits"])),
        found["hits"],
        lambda g, h: F.char_length(g) + F.char_length(h),
    )

    def spans(lengths: Column) -> Column:
        return F.zip_with(
            found["hits"],
            F.zip_with(
                running_before(lengths, 0, lambda a, x: a + x), lengths, lambda before, n: before + n
            ),
            lambda h, e: F.struct(
                (e - F.char_length(h)).alias("start"),
                found["rank"].alias("rank"),
                e.alias("end"),
                found["type"].alias("type"),
                h.alias("value"),
                found["base"].alias("base"),
            ),
        )

    return F.when(F.size(found["hits"]) > 0, bind(steps, spans)).otherwise(empty_array(_SPANS))


def _ranked_spans(text: Column, patterns: dict[str, str], case_sensitive_names: bool) -> Column:
    if not patterns:
        return empty_array(_SPANS)

    def parts(needs: Column) -> Column:
        return F.array(
            *[
                _hits(
                    text, needs, name, pattern, i,
                    not (case_sensitive_names and name == "potential_name"),
                )
                for i, (name, pattern) in enumerate(patterns.items())
            ]
        )

    needs = F.struct(*[test(text).alias(need) for need, test in _NEEDS.items()])
    spans = F.sort_array(F.flatten(F.transform(bind(needs, parts), _placed)))
    return F.when(text.isNotNull(), spans).otherwise(empty_array(_SPANS))


def _confidence(span: Column) -> Column:
    """Confidence of the type; a name shorter than 5 or longer than 50 counts half."""
    size = F.char_length(span["value"])
    odd = span["type"].isin("potential_name", "thai_name") & ((size < 5) | (size > 50))
    return F.when(odd, span["base"] * 0.5).otherwise(span["base"])


def _public(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["type"].alias("type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _confidence(s).alias("confidence"),
        ),
    )


def detect_pii(
    text: Column,
    custom_patterns: dict[str, str] | None = None,
    enabled_types: list[str] | None = None,
    case_sensitive_names: bool = False,
) -> Column:
    """Spans of personal data, by start and then by pattern order."""
    return _public(
        _ranked_spans(text, pii_patterns(custom_patterns, enabled_types), case_sensitive_names)
    )


def count_pii(text: Column, kind: str, custom_patterns: dict[str, str] | None = None) -> Column:
    """Number of matches of one type, without their places."""
    pattern = pii_patterns(custom_patterns)[kind]
    need = _need(kind, pattern)
    if pattern == rules.PII["email"]:
        n = F.floor((F.size(_mail_parts(text, True)) - 1) / 2).cast("int")
    else:
        n = F.regexp_count(text, F.lit(to_jvm(pattern)))
    return F.when(_NEEDS[need](text), n).otherwise(F.lit(0)) if need else n


def mask_value(kind: Column, value: Column, mask_char: str = "*") -> Column:
    """Mask of one value; it has the length of the value."""
    star = mask_char.replace("\\", "\\\\").replace("$", "\\$")
    size = F.char_length(value)

    def stars(n: Column) -> Column:
        return F.repeat(F.lit(mask_char), n)

    # most values have no space or one, which needs no search of every character
    gap = F.instr(value, " ")
    full = (
        F.when(gap == 0, stars(size))
        .when(F.position(F.lit(" "), value, gap + 1) == 0, F.concat(stars(gap - 1), F.lit(" "), stars(size - gap)))
        .otherwise(F.regexp_replace(value, "(?s)[^ ]", star))
    )
    user = F.substring_index(value, "@", 1)
    user_size = F.char_length(user)
    email = F.concat(
        F.when(
            user_size > 2,
            F.concat(F.substring(user, 1, 1), stars(user_size - 2), F.right(user, F.lit(1))),
        ).otherwise(stars(user_size)),
        F.lit("@"),
        F.substring_index(value, "@", -1),
    )
    phone = F.concat(F.left(value, F.lit(2)), stars(size - 4), F.right(value, F.lit(2)))
    but_last_four = r"\p{Nd}(?=(?:\P{Nd}*\p{Nd}){4})"
    digits = F.char_length(F.regexp_replace(value, r"\P{Nd}", ""))
    card = F.regexp_replace(value, but_last_four, star)
    thai_id = F.concat(
        F.substring(value, 1, 1),
        F.regexp_replace(F.substring(value, F.lit(2), size), but_last_four, star),
    )
    return (
        F.when((kind == "email") & (F.regexp_count(value, F.lit("@")) == 1), email)
        .when(kind.isin("phone_international", "phone_thai") & (size > 4), phone)
        .when((kind == "credit_card") & (digits > 4), card)
        .when((kind == "thai_id") & (digits >= 13), thai_id)
        .otherwise(full)
    )


def _apply_masks(text: Column, spans: Column, mask_char: str, merge_overlaps: bool) -> Column:
    """Write the masks of ``spans`` into ``text``.

    Where spans overlap, a character gets the mask of the span that starts
    first, and of the later pattern if two start together. With
    ``merge_overlaps`` everything under an overlapping span is starred.
    """

    def pieces(ordered: Column) -> Column:
        reach = running_before(ordered["end"], 0, lambda a, x: F.greatest(a, x))
        return F.filter(
            F.zip_with(
                ordered,
                reach,
                lambda s, r: F.struct(
                    F.greatest(s["start"], r).alias("start"),
                    s["end"].alias("end"),
                    F.substring(
                        mask_value(s["type"], s["value"], mask_char),
                        F.greatest(r - s["start"], F.lit(0)) + 1,
                        s["end"] - s["start"],
                    ).alias("mask"),
                ),
            ),
            lambda s: s["end"] > s["start"],
        )

    def join(kept: Column) -> Column:
        width = F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(F.size(kept))).cast("int"))
        return bind(width, lambda w: join_by(kept, w))

    def join_by(kept: Column, width: Column) -> Column:
        """Blocks of spans, so that few pieces are cut out of the whole text by their offset.

        Cutting walks the text from its start, hence blocks that widen with the text.
        """
        last = F.floor((F.size(kept) - 1) / width).cast("int")
        begin_of = lambda i: F.coalesce(
            F.get(kept, i)["start"], F.char_length(text)
        )

        def block(i: Column) -> Column:
            def cut(b: Column) -> Column:
                def written(part: Column) -> Column:
                    return F.transform(
                        part,
                        lambda s, j: F.concat(
                            s["mask"],
                            F.substring(
                                b["text"],
                                s["end"] - b["begin"] + 1,
                                F.coalesce(F.get(part, j + 1)["start"], b["stop"]) - s["end"],
                            ),
                        ),
                    )

                return F.array_join(bind(F.slice(kept, i * width + 1, width), written), "")

            begin, stop = begin_of(i * width), begin_of((i + 1) * width)
            return bind(
                F.struct(
                    begin.alias("begin"),
                    stop.alias("stop"),
                    F.substring(text, begin + 1, stop - begin).alias("text"),
                ),
                cut,
            )

        head = F.substring(text, F.lit(1), F.get(kept, F.lit(0))["start"])
        return F.when(F.size(kept) == 0, text).otherwise(
            F.concat(
                head, F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
            )
        )

    def by_place(raw: Column) -> Column:
        keyed = F.transform(
            raw,
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["rank"]).alias("rank"),
                s["end"].alias("end"),
                s["type"].alias("type"),
                s["value"].alias("value"),
            ),
        )
        return F.sort_array(keyed)

    def starred(ordered: Column) -> Column:
        reach = running_before(ordered["end"], 0, lambda a, x: F.greatest(a, x))
        after = F.transform(
            ordered, lambda s, i: F.coalesce(F.get(ordered, i + 1)["start"], s["end"])
        )
        return bind(
            F.struct(reach.alias("r"), after.alias("a")),
            lambda ra: F.transform(
                ordered,
                lambda s, i: F.when(
                    (F.get(ra["r"], i) > s["start"]) | (F.get(ra["a"], i) < s["end"]),
                    F.struct(
                        s["start"].alias("start"),
                        s["rank"].alias("rank"),
                        s["end"].alias("end"),
                        F.lit("").alias("type"),
                        s["value"].alias("value"),
                    ),
                ).otherwise(s),
            ),
        )

    def straight(apart: Column) -> Column:
        masked = lambda s: F.struct(s["start"], s["end"], mask_value(s["type"], s["value"], mask_char).alias("mask"))
        return F.transform(F.filter(apart, lambda s: s["end"] > s["start"]), masked)

    def overlap(given: Column) -> Column:
        others = F.greatest(F.size(given) - 1, F.lit(0))
        over = F.zip_with(F.slice(given["end"], F.lit(1), others), F.slice(given["start"], F.lit(2), others), lambda e, s: e > s)
        return F.exists(over, lambda o: o)

    def placed(given: Column) -> Column:
        """Spans that lie apart are in their place; only others are put in order and cut."""
        ordered = by_place(given)
        if merge_overlaps:
            ordered = bind(ordered, starred)
        return F.when(overlap(given), bind(ordered, pieces)).otherwise(straight(given))

    return bind(bind(spans, placed), join)


def mask_pii(
    text: Column,
    custom_patterns: dict[str, str] | None = None,
    enabled_types: list[str] | None = None,
    allowed_types: list[str] | None = None,
    mask_char: str = "*",
    case_sensitive_names: bool = False,
    merge_overlaps: bool = False,
) -> Column:
    """Struct ``masked_text, spans``: all spans found, those of allowed types left unmasked."""
    _check_mask(mask_char)
    patterns = pii_patterns(custom_patterns, enabled_types)

    def respond(spans: Column) -> Column:
        return F.struct(
            F.when(
                F.size(spans) > 0,
                _apply_masks(text, _not_allowed(spans, allowed_types), mask_char, merge_overlaps),
            )
            .otherwise(text)
            .alias("masked_text"),
            _public(spans).alias("spans"),
        )

    return bind(_ranked_spans(text, patterns, case_sensitive_names), respond)


def _check_mask(mask_char: str) -> None:
    if len(mask_char) != 1:
        raise ValueError("mask_char must be one character: offsets rest on equal lengths")


def _not_allowed(spans: Column, allowed: list[str] | None) -> Column:
    if not allowed:
        return spans
    return F.filter(spans, lambda s: ~s["type"].isin(*allowed))


def pii_check(
    view: TextView,
    mask: bool = True,
    allowed_types: list[str] | None = None,
    fail_on_pii: bool = True,
    mask_char: str = "*",
    custom_patterns: dict[str, str] | None = None,
    enabled_types: list[str] | None = None,
    case_sensitive_names: bool = False,
    enabled: bool = True,
) -> Verdict:
    """Verdict on personal data; the message lists the types of all spans in order."""
    name = "PIIDetector"
    skipped_text = "Validation skipped (disabled or empty input)"
    if not enabled:
        return skipped(name, skipped_text)
    _check_mask(mask_char)
    patterns = pii_patterns(custom_patterns, enabled_types)
    blank = tx.is_blank(view.text)
    lead = "PII detected: [" if fail_on_pii else "PII detected but allowed: ["

    def respond(f: Column) -> Column:
        some, kept = F.size(f["all"]) > 0, F.size(f["kept"]) > 0
        fields = [
            _public(f["all"]).alias("detected_pii"),
            _public(f["kept"]).alias("filtered_pii"),
        ]
        if mask:
            fields.append(
                _apply_masks(view.text, f["kept"], mask_char, False).alias("masked_text")
            )
        listed = F.array_join(F.transform(f["kept"]["type"], lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
        return response(
            name,
            F.when(kept, FAIL if fail_on_pii else WARNING).otherwise(PASS),
            F.when(blank, skipped_text)
            .when(kept, F.concat(F.lit(lead), listed, F.lit("]")))
            .when(some, "Only allowed PII types detected")
            .otherwise("No PII detected"),
            F.when(blank, 1.0).when(kept, 0.9).when(some, 0.8).otherwise(0.9),
            F.when(kept, F.to_json(F.struct(*fields))).when(
                some, F.to_json(F.struct(_public(f["all"]).alias("detected_pii")))
            ),
        )

    spans = bind(
        _ranked_spans(view.text, patterns, case_sensitive_names),
        lambda s: F.struct(s.alias("all"), _not_allowed(s, allowed_types).alias("kept")),
    )
    return Verdict(spans, respond)
