"""License scan: fixed phrases in whole texts, and an exact set-similarity join of text blocks with templates.

A block is a run of words of the whole text, line feeds or not, twice as long as the template: line wrapping and
missing line breaks change nothing, and words far apart do not add up. No block reaches over a word that the template
bars ("lesser" before a GPL notice). Its tokens are its distinct words. A block meets a template when it holds at least
``threshold`` of the template's distinct words and all its telling ones ("mit"), which alike notices differ by. The join
is exact over all overlapping blocks and uses three filters over tokens in one global order, rarest in the corpus first:

* length: a text, and later the surroundings of a word, with fewer distinct template words than the least need end early;
* prefix: a block that meets the template holds one of the template's first |T| - need + 1 tokens. Only the
  surroundings of such words leave a text, so blocks without one are never formed;
* position: around token p of a template's order only blocks count that hold no earlier one (those that do are found
  around that one), so only tokens from p on add up, and surroundings with fewer than ``need`` of these end.

The template vocabulary (a few hundred words, a parameter) is the only thing counted to the driver: its corpus
frequencies make the global order. All work is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of a block for each word of the template: a notice may have as many words put in as it has itself.
RUN = 2
#: Phrases and the labels they stand for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as their licences or stewards word them, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "either version 3 of the GNU General Public License, or (at your option) any later version",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Words that a block must hold besides: what tells a notice from alike ones.
TELLING = {
    "Apache-2.0": ("apache", "2"),
    "CC-BY-4.0": ("creative", "commons", "attribution", "4"),
    "CC-BY-NC-4.0": ("cc", "by", "nc", "4"),
    "CC0-1.0": ("waived",),
    "GPL-3.0": ("gnu", "general", "public", "3"),
    "GPL-3.0-or-later": ("gnu", "general", "public", "3", "later"),
    "MIT": ("mit",),
    "MPL-2.0": ("mozilla", "2"),
}
#: Words that no block of the template holds: they make a notice that of another licence.
BARRED = {
    "CC-BY-4.0": ("sharealike", "noncommercial", "noderivatives", "noderivs", "sa", "nc", "nd"),
    "CC-BY-NC-4.0": ("sa", "nd"),
    "GPL-3.0": ("lesser", "affero"),
    "GPL-3.0-or-later": ("lesser", "affero"),
}


def words_of(text: str) -> list[str]:
    """Words of a template or phrase (driver side)."""
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def needed(n_tokens: int, threshold: float) -> int:
    return math.ceil(round(threshold * n_tokens, 9))


def _spread(lowered: Column) -> Column:
    """Every word with a space of its own on either side, so that neighbouring phrases share none."""
    words = F.trim(F.regexp_replace(lowered, GAP, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _words_in(spread: Column) -> Column:
    return (F.length(spread) - F.length(F.replace(spread, F.lit(" "), F.lit("")))) / 2


def _phrase_columns(spread: str, n_words: str, phrases: Mapping[str, str]) -> dict[str, Column]:
    counts, firsts, lasts, labels = [], [], [], []
    s = F.col(spread)
    for phrase, label in phrases.items():
        words = words_of(phrase)
        needle = " " + "  ".join(words) + " "
        there = s.contains(needle)
        counts.append(F.when(there, F.regexp_count(s, F.lit("(?=" + re.escape(needle).replace("\\ ", " ") + ")"))).otherwise(0))
        before = F.substring(s, F.lit(1), F.instr(s, needle) - 1)
        firsts.append(F.when(there, _words_in(before)))
        turned = F.reverse(s)
        after = F.substring(turned, F.lit(1), F.instr(turned, needle[::-1]) - 1)
        lasts.append(F.when(there, F.col(n_words) - _words_in(after) - len(words)))
        labels.append(F.when(there, F.lit(label)))
    least = F.least if len(firsts) > 1 else (lambda x: x)
    most = F.greatest if len(lasts) > 1 else (lambda x: x)
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return {
        "n_base": total.cast("long"),
        "first_word": least(*firsts).cast("long"),
        "last_word": most(*lasts).cast("long"),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")]


def word_list(text: Column) -> Column:
    """All words of a text in order, over line breaks."""
    return F.split(F.trim(F.regexp_replace(lower_ascii(whole(text)), GAP, " ")), " ")


def surroundings(docs: DataFrame, tokens: list[str], vocabulary: list[str], least: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, token, before, after): every place of one of the tokens, with ``reach`` words on either side; equal places
    of a text once. Texts with fewer than ``least`` words of the vocabulary have none."""
    rows = docs.select(*_key(id_col, text_col), word_list(F.col(text_col)).alias("words"))
    wanted = F.array(*[F.lit(t) for t in tokens])
    # texts without any of the tokens, nearly all of them, end here
    rows = rows.where(F.arrays_overlap("words", wanted) & (F.size(F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.col("words"))) >= least))
    words = F.col("words")
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull())
    around = F.transform(
        places,
        lambda i: F.struct(
            F.element_at(words, i + 1).alias("token"), F.slice(words, F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach))).alias("before"), F.slice(words, i + 2, F.lit(reach)).alias("after")
        ),
    )
    return rows.select("doc_id", "text_hash", F.explode(F.array_distinct(around)).alias("p")).select("doc_id", "text_hash", "p.*")


def _until(words: Column, barred: Column) -> Column:
    """The words before the first barred one."""
    stop = F.array_min(F.filter(F.transform(barred, lambda b: F.array_position(words, b)), lambda i: i > 0))
    return F.when(stop.isNull(), words).otherwise(F.slice(words, F.lit(1), (stop - 1).cast("int")))


def block_matches(
    docs: DataFrame, templates: Mapping[str, str], threshold: float, id_col: str, text_col: str, telling: Mapping[str, tuple[str, ...]] = TELLING, barred: Mapping[str, tuple[str, ...]] = BARRED
) -> DataFrame:
    """(doc_id, text_hash, label, containment) of the best block around each prefix token that meets the threshold."""
    spark = docs.sparkSession
    sets = {label: sorted(set(words_of(t))) for label, t in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    # at most one row for each template word comes to the driver
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), word_list(F.col(text_col)))
    frequency = {r["token"]: r["count"] for r in docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()}
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows, lengths = [], {label: RUN * len(words_of(t)) for label, t in templates.items()}
    for label, s in sets.items():
        ordered, need = sorted(s, key=place.__getitem__), needed(len(s), threshold)
        own = (label, len(s), need, lengths[label], list(telling.get(label, ())), list(barred.get(label, ())))
        rows += [(*own, ordered[i], ordered[i:]) for i in range(len(ordered) - need + 1)]
    fields = "label string, tokens int, need int, length int, telling array<string>, barred array<string>, token string, rest array<string>"
    prefixes = spark.createDataFrame(rows, fields)
    least = min((r[2] for r in rows), default=1)
    near = surroundings(docs, sorted({r[6] for r in rows}), vocabulary, least, max(lengths.values()) - 1, id_col, text_col)
    met = near.join(F.broadcast(prefixes), "token")
    n = F.col("length") - 1
    left = F.reverse(_until(F.reverse(F.slice("before", F.greatest(F.lit(1), F.size("before") - n + 1), n)), F.col("barred")))
    met = met.withColumns({"left": left, "right": _until(F.slice("after", F.lit(1), n), F.col("barred"))})
    met = met.withColumns({"words": F.concat("left", F.array("token"), "right"), "at": F.size("left")})
    met = met.where((F.size(F.array_intersect("rest", "words")) >= F.col("need")) & (F.size(F.array_except("telling", "words")) == 0))

    def of_run(k: Column) -> Column:
        run = F.slice("words", k + 1, F.col("length"))
        return F.when(F.size(F.array_except("telling", run)) == 0, F.size(F.array_intersect("rest", run)))

    # every run of the block's length around the token: it starts at the token or before it
    met = met.withColumn("shared", F.array_max(F.transform(F.sequence(F.lit(0), F.col("at")), of_run))).where(F.col("shared") >= F.col("need"))
    return met.select("doc_id", "text_hash", "label", (F.col("shared") / F.col("tokens")).alias("containment"))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    telling: Mapping[str, tuple[str, ...]] = TELLING, barred: Mapping[str, tuple[str, ...]] = BARRED,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    ``score`` is 1 where a phrase stands, else the best containment of a block in a template that meets the
    threshold, else 0. Null and empty texts have no words, empty labels and score 0. Rows that repeat an id have
    one row each, with labels of their own text. Other columns are not read; an empty table gives an empty
    result (its frequencies are all zero).
    """
    lowered = lower_ascii(whole(F.col(text_col)))
    base = docs.select(*_key(id_col, text_col), _spread(lowered).alias("spread"))
    base = base.withColumn("n_words", _words_in(F.col("spread")).cast("long"))
    base = base.select("doc_id", "text_hash", "n_words", *[c.alias(n) for n, c in _phrase_columns("spread", "n_words", phrases).items()])
    found = block_matches(docs, templates, threshold, id_col, text_col, telling, barred)
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    f = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "more", "best")
    out = base.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    everything = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(everything, ",").alias("labels"), score.alias("score"))


def sql(phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    def quoted(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    spots = []
    for phrase, label in phrases.items():
        words = words_of(phrase)
        test = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
        spots.append(f"list_transform(list_filter(range(len(w) - {len(words)} + 1), lambda i: {test}), lambda i: {{'i': i, 'label': '{label}'}})")
    rows = ", ".join(
        f"('{label}', {quoted(sorted(set(words_of(t))))}, {needed(len(set(words_of(t))), threshold)}, {RUN * len(words_of(t))}, {quoted([*TELLING.get(label, ())])}::varchar[], {quoted([*BARRED.get(label, ())])}::varchar[])"
        for label, t in templates.items()
    )
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with t(label, wanted, need, length, telling, barred) as (values {rows}),
d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
w as (select doc_id, low, regexp_extract_all(low, '{pattern}') as w from d),
p as (select doc_id, low, len(w) as n_words, list_concat({", ".join(spots)}) as spots from w),
-- runs that start at a template word, up to the first barred one; texts that lack the words as a whole have none
c as (select doc_id, w, t.* from w join t on len(list_intersect(list_distinct(w), wanted)) >= need and list_has_all(w, telling)),
r as (select doc_id, label, wanted, need, telling, w[i : i + length - 1] as run, barred
      from (select *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(wanted, w[i]))) as i from c)),
k as (select doc_id, label, wanted, need, telling,
             list_distinct(run[1 : coalesce(list_min(list_filter(list_transform(barred, lambda b: list_position(run, b)), lambda x: x > 0)) - 1, len(run))]) as words from r),
m as (select doc_id, list(distinct label) as more, max(len(list_intersect(words, wanted)) / len(wanted)) as best
      from k where len(list_intersect(words, wanted)) >= need and list_has_all(words, telling) group by doc_id)
select p.doc_id, cast(n_words as bigint) as n_words, cast(len(spots) as bigint) as n_base,
       cast(list_min(list_transform(spots, lambda s: s.i)) as bigint) as first_word, cast(list_max(list_transform(spots, lambda s: s.i)) as bigint) as last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(spots, lambda s: s.label))), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(spots, lambda s: s.label), coalesce(more, []::varchar[])))), ','), '') as labels,
       case when len(spots) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from p left join m using (doc_id)
"""
