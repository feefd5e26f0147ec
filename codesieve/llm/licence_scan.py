"""Licence scans: ordered signature rules behind a keyword prefilter. DataFrame operations only.

A text becomes its words (A-Z lowered), joined by single blanks. Rules are regular expressions over that, made from the
table of licences and the forms in which each is named. A rule has several keywords: one of each text that its name or
identifiers can be, so that whatever it matches holds one of them as a word. Signatures of licence bodies and notices are
written by hand, each with a keyword of its own. Texts without a trigger or a signature's keyword stop there. The others meet, through an equi-join on the keywords they hold, only the rules that those open, each once (the rule table is
of fixed size, and broadcast). Detections are intervals of words; one that lies within another of the same or a stronger
priority is suppressed, by running maxima over the intervals of its text in order. What remains gives labels and score.

Base phrases are counted in the row itself, whether or not a rule finds them. Null texts have no words. Repeated rows
are scanned alike.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.llm.common import ascii_lower, settle

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
#: label, preferred keyword, name as a pattern over words, identifiers as a pattern.
LICENCES = [
    ("mit", "mit", "mit", "mit"), ("apache", "apache", "apache(?: software)?", "apache 2 0"), ("gpl", "gpl", "gpl ?v?(?:1|2|3)?", "gpl (?:1|2|3) 0(?: only| or later)?"),
    ("gpl", "general", "(?:gnu )?general public", "gnu gpl"), ("lgpl", "lgpl", "lgpl ?v?(?:2|3)?", "lgpl (?:2|2 1|3) ?0?(?: only| or later)?"), ("lgpl", "lesser", "(?:gnu )?lesser general public", "gnu lgpl"),
    ("agpl", "agpl", "agpl ?v?3?", "agpl 3 0(?: only| or later)?"), ("agpl", "affero", "(?:gnu )?affero general public", "gnu agpl"), ("bsd", "bsd", "(?:modified |new |simplified |revised )?bsd(?: style)?", "(?:0bsd|bsd (?:2|3|4) clause)"),
    ("isc", "isc", "isc", "isc"), ("mpl", "mozilla", "mozilla public", "mpl (?:1 1|2 0)"), ("mpl", "mpl", "mpl ?(?:1 1|2 0)?", "mpl 2 0"), ("epl", "eclipse", "eclipse public", "epl (?:1|2) 0"),
    ("cddl", "cddl", "cddl", "cddl 1 (?:0|1)"), ("cddl", "distribution", "common development and distribution", "cddl"), ("cc0", "cc0", "cc0", "cc0 1 0"), ("cc-by", "creative", "creative commons attribution", "cc by (?:3|4) 0"),
    ("cc-by", "cc", "cc by", "cc by (?:2|2 5|3|4) 0"), ("cc-by-sa", "sa", "cc by sa", "cc by sa (?:3|4) 0"), ("cc-by-nc", "nc", "cc by nc", "cc by nc (?:3|4) 0"), ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"), ("boost", "boost", "boost(?: software)?", "bsl 1 0"), ("artistic", "artistic", "(?:perl )?artistic", "artistic (?:1|2) 0"), ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python", "psf", "psf", "psf 2 0"), ("python", "python", "python(?: software foundation)?", "python 2 0"), ("php", "php", "php", "php 3 0(?:1)?"), ("ruby", "ruby", "ruby", "ruby"), ("eupl", "eupl", "eupl", "eupl 1 (?:1|2)"),
    ("eupl", "european", "european union public", "eupl"), ("ms-pl", "microsoft", "microsoft public", "ms pl"), ("ofl", "ofl", "(?:sil )?ofl", "ofl 1 1"), ("ofl", "font", "(?:sil )?open font", "ofl"), ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa", "ncsa"), ("w3c", "w3c", "w3c(?: software)?", "w3c"), ("osl", "osl", "osl", "osl 3 0"), ("afl", "academic", "academic free", "afl 3 0"),
    ("gfdl", "gfdl", "gfdl", "gfdl 1 (?:1|2|3)(?: only| or later)?"), ("gfdl", "documentation", "(?:gnu )?free documentation", "gnu fdl"), ("odbl", "odbl", "odbl", "odbl 1 0"), ("odbl", "database", "open database", "odbl"), ("vim", "vim", "vim", "vim"),
    ("public-domain", "domain", "public domain", "public domain"), ("proprietary", "rights", "proprietary", "all rights reserved"), ("proprietary", "commercial", "commercial", "commercial"),
]
#: Form, priority (1 is the strongest), weight, pattern with N for the name and I for the identifiers.
FORMS = [
    ("tag", 1, 1.0, "spdx license identifier(?: I)"), ("grant", 2, 0.9, "(?:is |are )?(?:dual )?(?:licensed|released|distributed|provided|made available|published) under (?:the )?(?:terms of )?(?:the )?N(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
    ("subject", 2, 0.85, "subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N(?: licen[sc]e)?"), ("version", 3, 0.8, "N licen[sc]e version [0-9]+(?: [0-9]+)?"), ("link", 3, 0.75, "(?:opensource org licenses?|www gnu org licenses|spdx org licenses) I"),
    ("name", 4, 0.6, "N licen[sc]e"), ("heading", 4, 0.5, "licen[sc]e (?:type |name )?N"),
]
#: Licence bodies and notices, written by hand: label, keyword (a word of every match), pattern over words.
SIGNATURES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software(?!(?: and associated documentation files)?(?: the software)? to deal with)"),
    ("ncsa", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?(?: the software)? to deal with the software"),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation"),
    ("ofl", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsd", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided that)"),
    ("postgresql", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("apache", "hereby", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license"),
    ("apache", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms(?: with or without modification)?"),
    ("bsd", "redistributions", "redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd", "endorse", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|the|other) (?:[^ ]+ ){0,3}contributors may be used to endorse or promote products"),
    ("gpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "(?:you )?just do what the fuck you want to"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "incompatible", "this source code form is incompatible with secondary licenses"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cc0", "waived", "(?:has )?waived all copyright and related or neighbou?ring rights"),
    ("artistic", "intent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("python", "psf", "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("w3c", "licensee", "by obtaining(?: using)? and or copying this work you the licensee agree"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
]
#: Priority and weight of a signature.
BODY = (2, 0.95)
TRIGGER = "licen[sc]e|spdx|subject to|released under|distributed under|published under|provided under|available under"


def variants(pattern: str) -> list[str]:
    """Every text that a pattern of literals, groups (?:a|b) and question marks matches."""
    def choice(at: int) -> tuple[list[str], int]:
        out, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, now, at = out + now, [""], at + 1
                continue
            part, at = choice(at + 3) if pattern.startswith("(?:", at) else ([pattern[at]], at)
            at += 1
            if pattern[at:at + 1] == "?":
                part, at = ["", *part], at + 1
            now = [x + y for x in now for y in part]
        return out + now, at
    return choice(0)[0]


def keywords(pattern: str, preferred: str) -> list[str]:
    """A word of every variant: the preferred one where it stands, else the longest that is no number, of equals the last."""
    best = lambda words_: max(enumerate(words_), key=lambda w: (w[1] == preferred, not w[1].isdigit(), len(w[1]), w[0]))[1]
    return sorted({best(v.split()) for v in variants(pattern)})


def rules() -> list[tuple[int, str, list[str], str, int, float]]:
    """(number, label, keywords, pattern over joined words, priority, weight), in order."""
    made = [(label, keywords(name if "N" in form else ids, keyword), f"(?<= )(?:{form.replace('N', f'(?:{name})').replace('I', f'(?:{ids})')})(?= )", priority, weight)
            for _, priority, weight, form in FORMS for label, keyword, name, ids in LICENCES]
    made += [(label, [keyword], f"(?<= )(?:{pattern})(?= )", *BODY) for label, keyword, pattern in SIGNATURES]
    return [(n, *rule) for n, rule in enumerate(made)]


def rule_table(spark: SparkSession) -> DataFrame:
    """A row for each keyword of a rule; `earlier` are those of its keywords that come before."""
    rows = [(n, label, word, words_[:k], pattern, priority, weight) for n, label, words_, pattern, priority, weight in rules() for k, word in enumerate(words_)]
    return spark.createDataFrame(rows, "rule int, label string, keyword string, earlier array<string>, pattern string, priority int, weight double")


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def base_places(words_: Column) -> Column:
    """(place, label) of each base phrase, in order of phrases."""
    def places(label: str, phrase: list[str]) -> Column:
        def stands(i: Column) -> Column:
            out = F.get(words_, i) == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                out = out & (F.get(words_, i + k) == word)
            return out
        spots = F.filter(F.sequence(F.lit(0), F.size(words_) - len(phrase)), stands)
        return F.when(F.size(words_) >= len(phrase), F.transform(spots, lambda i: F.struct(i.alias("place"), F.lit(label).alias("label"))))
    none = F.array().cast("array<struct<place:int,label:string>>")
    each = [F.coalesce(places(*b), none) for b in BASE]
    return F.when(F.array_contains(words_, "license"), F.concat(*each)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, base, and (where a trigger stands) the joined words and keywords of every row; stored."""
    known = sorted({word for r in rules() for word in r[2]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), base_places(F.col("words")).alias("base"), "words", joined.alias("joined"))
    bodies = F.array(*map(F.lit, sorted({keyword for _, keyword, _ in SIGNATURES})))
    open_ = F.col("joined").rlike(f" (?:{TRIGGER})") | F.arrays_overlap("words", bodies)
    return settle(rows.select("rid", "doc_id", "n_words", "base", F.when(open_, F.col("joined")).alias("joined"),
                              F.when(open_, F.array_intersect(F.array(*map(F.lit, known)), "words")).alias("keywords")), "op7-scan")


def detections(scanned: DataFrame) -> DataFrame:
    """rid, rule, label, priority, weight, first, last (words, inclusive) of what the rules match, suppressed or not."""
    table = F.broadcast(rule_table(scanned.sparkSession))
    rows = scanned.where("joined is not null").select("rid", "joined", "keywords", F.explode("keywords").alias("keyword")).join(table, "keyword")
    # A rule that several words of a text open is tried at the first of its keywords only.
    rows = rows.where(~F.arrays_overlap("keywords", "earlier") & F.rlike(F.col("joined"), F.col("pattern")))
    gaps, found = F.split("joined", F.col("pattern"), -1), F.regexp_extract_all(F.col("joined"), F.col("pattern"), F.lit(0))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(blanks(g).alias("gap"), blanks(m).alias("inner")))
    hits = F.transform(both, lambda b, n: F.struct(n.alias("n"), b["gap"].alias("gap"), b["inner"].alias("inner")))
    # The last gap has no match after it.
    rows = rows.select("rid", "rule", "label", "priority", "weight", F.inline(hits)).where("inner is not null")
    upto = Window.partitionBy("rid", "rule").orderBy("n")
    # The first blank of the text stands before word 0, and a match begins after the blank of its gap.
    end = F.sum(F.col("gap") + F.col("inner")).over(upto) - 1
    return rows.select("rid", "rule", "label", "priority", "weight", (end - F.col("inner")).alias("first"), end.alias("last"))


def surviving(found: DataFrame) -> DataFrame:
    """The detections that no other of the same or a stronger priority contains."""
    before = Window.partitionBy("rid").orderBy("first", F.col("last").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({p for _, p, _, _ in FORMS})
    reach = [F.max(F.when(F.col("priority") <= p, F.col("last"))).over(before).alias(f"reach{p}") for p in levels]
    rows = found.select("*", *reach)
    own = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels])
    return rows.where(own.isNull() | (own < F.col("last"))).drop(*[f"reach{p}" for p in levels])


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    scanned = scan(docs)
    found = settle(surviving(detections(scanned)), "op7-found").groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("weight").alias("weight"))
    rows = scanned.drop("joined", "keywords").join(found, "rid", "left")
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    all_ = F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))
    places = F.transform("base", lambda b: b["place"])
    score = F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
                       F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(all_), ",").alias("labels"), score.alias("score"))
