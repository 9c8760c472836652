"""Problem 9: subject areas of documents, by labels that spread over a similarity graph.

Passages (sentences, and the agenda item) are compared by their content terms, those
that lean to a subject far beyond chance for their language. Passages with equal sets
of them are one node; nodes whose sets overlap by half or more are neighbours, every
overlap verified by the similarity join of problem 5. Labels given by hand are the
seeds: the passages of a labelled document are clamped to its subjects (at the end
only of those whose annotators agree). A round sums the shares of the passages by
node, sends them along the edges, and sums the nodes' shares by document; documents
that were reached pass theirs on in the next round. A document keeps every subject
that enough of its sentences speak about. The graph is built twice, the second time
with terms chosen by what the first one gave, and spread over from the seeds anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.similar import similar_sets
from kmerloom.session import broadcast_if_small, numbered, stored

#: Subjects that the columns of a run may spread over.
MOST_SUBJECTS = 200
#: Rounds over each of the graphs that are built one after another.
ROUNDS = (2, 3)
#: Least overlap (common terms by all terms) of neighbours, share that a node takes over from them, steps of it in a round.
SIMILAR, BETA, HOPS = 0.5, 0.8, 1
#: Weight of the corpus's shares in those of a node and of a document.
NODE_PRIOR, DOCUMENT_PRIOR = 0.05, 0.5
#: Share of no subject at all in a document with subjects; share of a document's passages that must be reached for its terms to count.
PLAIN, HEARD = 0.05, 0.3
#: Likelihood ratio (G) beyond which a term's lean to a subject is verified; least odds ratio and share of the subject.
VERIFIED_G, VERIFIED_ODDS, VERIFIED_SHARE = 12.0, 3.0, 0.25
#: Sentences with a word beside which sentences rarely agree with their document (comparisons, asides) don't count.
AGREEMENT, AGREEMENT_SENTENCES = 0.35, 20
CONFIDENT = 0.6
SENTENCE_END = r"(?<=[.!?…])\s+|[\r\n\u0085\u2028\u2029]+"
WORD = r"\p{L}+(?:-\p{L}+)*"


def sentences(docs: DataFrame, key: str, text: str, hint: str | None = None) -> DataFrame:
    """(doc, s, terms): the distinct words of three letters or more of each sentence, hashed.

    With `hint` its words stand in a sentence -1 as terms of their own kind.
    """

    def terms(x: Column, kind: int) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), 1))
        return F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.xxhash64(w, F.lit(kind)))

    each = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, SENTENCE_END)).alias("s", "x")).select("doc", "s", terms(F.col("x"), 0).alias("terms"))
    if hint:
        each = each.unionByName(docs.filter(F.col(hint).isNotNull()).select(F.col(key).alias("doc"), F.lit(-1).alias("s"), terms(F.col(hint), 1).alias("terms")))
    return each.filter(F.size("terms") > 0)


def seed_labels(labels: DataFrame, key: str, subject: str, annotator: str, subjects: list[str]) -> DataFrame:
    """(doc, seeds, trusted): the subjects that at least half of a document's annotators gave; 'none' and unknown names give none.

    A document is trusted if two annotators or more labelled it and all its subjects were given by each of them.
    """
    given = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.lower(F.trim(subject)).alias("subject"), F.coalesce(F.col(annotator), F.lit("")).alias("by")).distinct()
    of = given.groupBy("doc").agg(F.count_distinct("by").alias("n"))
    votes = given.groupBy("doc", "subject").agg(F.count_distinct("by").alias("v"))
    kept = F.when((F.col("v") * 2 >= F.col("n")) & F.col("subject").isin([s.lower() for s in subjects]), F.col("subject"))
    return votes.join(of, "doc").groupBy("doc").agg(F.collect_set(kept).alias("seeds"), ((F.first("n") > 1) & (F.min("v") == F.first("n"))).alias("trusted"))


class SubjectGraph:
    """Columns numbered 0 to K-1 are the subjects, K is none of them."""

    def __init__(self, subjects: list[str]):
        if not 2 <= len(subjects) <= MOST_SUBJECTS:
            raise ValueError(f"from 2 to {MOST_SUBJECTS} subjects")
        self.subjects = subjects
        self.n = range(len(subjects) + 1)

    def cols(self, x: str) -> list[Column]:
        return [F.col(f"{x}{c}") for c in self.n]

    def each(self, text: str, to: str) -> list[str]:
        """SQL of one column for each number, which stands as # in the text."""
        return [f"{text.replace('#', str(c))} as {to}{c}" for c in self.n]

    def total(self, text: str) -> str:
        return "(" + " + ".join(text.replace("#", str(c)) for c in self.n) + ")"

    def _summed(self, df: DataFrame, key: str | None, *aggs: str) -> DataFrame:
        return (df.groupBy(key) if key else df.groupBy()).agg(*[F.expr(x) for x in aggs])

    def _bases(self, shares: DataFrame) -> DataFrame:
        """(lang, b*): shares in each language, from documents (lang, q*), drawn to those of all languages by 20 documents.

        A document counts once, however long it is.
        """
        sums = self._summed(shares, "lang", "count(*) as n", *self.each("sum(q#)", "q"))
        every = self._summed(sums, None, "sum(n) as every", *self.each("sum(q#)", "t"))
        return sums.crossJoin(F.broadcast(every)).selectExpr("lang", *self.each("(q# + 20 * t# / every + 1e-6D) / (n + 20)", "b"))

    def _content(self, shares: DataFrame, docs: DataFrame) -> DataFrame:
        """(term): the terms with a verified lean, from rows (lang, terms, q*) and documents (lang, q*)."""
        bases = F.broadcast(self._bases(docs))  # a row for each language; 1-row crossJoin above
        own = shares.join(bases, shares["lang"].eqNullSafe(bases["lang"])).selectExpr("explode(terms) as term", *self.each("q#", "q"), *self.each("b#", "b"))
        sums = self._summed(own, "term", "count(*) as n", *self.each("sum(q#)", "q"), *self.each("sum(b#)", "b"))  # b: what the languages of its sentences let expect
        shared = sums.selectExpr("*", *self.each("(q# + 2 * b# / n) / (n + 2)", "s"))
        g = f"2 * {self.total('if(q# > 1e-9D, q# * ln(q# / b#), 0D)')} > {VERIFIED_G}D"
        odds = [x.removesuffix(f" as o{c}") for c, x in zip(self.n, self.each("s# / (1.000001D - s#) * (1.000001D - b# / n) / (b# / n)", "o"))]
        lean = f"greatest({', '.join(odds)}) > {VERIFIED_ODDS}D and greatest({', '.join(f's{c}' for c in self.n)}) > {VERIFIED_SHARE}D"
        return stored(shared.filter(f"n >= 2 and {g} and {lean}").select("term"))

    def similarity(self, full: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows, nodes, edges): rows(doc, s, node) of the passages with content terms, nodes(node, members), edges(src, dst, overlap) in both directions."""
        own = full.select("doc", "s", F.explode("terms").alias("term")).join(broadcast_if_small(content), "term").groupBy("doc", "s").agg(F.sort_array(F.collect_list("term")).alias("members"))
        own = stored(own.withColumns({"h1": F.xxhash64("members"), "h2": F.xxhash64(F.reverse("members"), F.lit(1))}))
        nodes = numbered(own.groupBy("h1", "h2").agg(F.first("members").alias("members")), "node")
        rows = stored(own.select("doc", "s", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc", "s", "node"))
        pairs = similar_sets(nodes, "node", "members", SIMILAR, 1)[0]
        overlap = (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("overlap")
        one = pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"), overlap)
        two = pairs.select(F.col("id_b").alias("src"), F.col("id_a").alias("dst"), overlap)
        return rows, nodes.select("node", "members"), stored(one.unionByName(two))

    def _shared(self, cells: DataFrame, place: DataFrame, nodes: DataFrame | None) -> DataFrame:
        """cells(doc, node, n) with their shares y*: those of the node and of the document put together, within the subjects open to it."""
        own = ["doc", "node", "n", "weight"]
        both = cells.join(place, "doc")
        if nodes is not None:
            both, own = both.join(nodes, "node"), [*own, "reach"]
        x = both.selectExpr(*own, *self.each("q# * sqrt(q#) * p# * m#" if nodes is not None else "p# * m#", "y"))
        return x.selectExpr("*", f"{self.total('y#')} + 1e-12D as total").selectExpr(*own, *self.each("y# / total", "y"))

    def _row(self, shares: DataFrame) -> DataFrame:
        """The one row of shares as a table that costs no job, even ones if there are none."""
        row = [x if x is not None and x == x else 1 / len(self.n) for x in shares.first()]
        return shares.sparkSession.createDataFrame([row], ", ".join(f"t{c} double" for c in self.n))

    def _sent(self, cells: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, prior): nodes(node, q*, reach) after the shares of the cells went along the edges, and the shares of all."""
        start = stored(self._summed(cells, "node", *self.each("sum(n * weight * y#)", "f")))
        now = start
        for _ in range(HOPS):
            got = self._summed(edges.join(now, edges["src"] == now["node"]), "dst", *self.each("sum(part * f#)", "g")).withColumnRenamed("dst", "node")
            now = start.join(got, "node", "full").selectExpr("node", *self.each(f"coalesce(f#, 0D) + {BETA}D * coalesce(g#, 0D)", "f"))
        now = stored(now)
        total = f"{self.total('f#')} as total"
        prior = self._summed(now, None, *self.each("sum(f#)", "f")).selectExpr("*", total).selectExpr(*self.each("(f# + 1e-9D) / total", "t"))
        prior = self._row(prior)
        nodes = now.selectExpr("*", total).crossJoin(F.broadcast(prior)).selectExpr("node", *self.each(f"(f# + {NODE_PRIOR}D * t#) / (total + {NODE_PRIOR}D)", "q"), f"total / (total + {NODE_PRIOR}D) as reach")
        return nodes, prior

    def _documents(self, cells: DataFrame, place: DataFrame, prior: DataFrame) -> DataFrame:
        """place with the shares p* of each document from its cells, clamped to its subjects, and its weight: the part of its passages that is reached."""
        sums = self._summed(cells, "doc", *self.each("sum(n * reach * y#)", "f"))
        fixed = ["doc", "lang", "seed", "trusted", "n_passages", *[f"m{c}" for c in self.n]]
        own = place.select(*fixed).join(sums, "doc", "left").selectExpr(*fixed, *self.each("coalesce(f#, 0D)", "f"))
        own = own.selectExpr("*", f"{self.total('f#')} as total").crossJoin(F.broadcast(prior))
        share = f"(f# + {DOCUMENT_PRIOR}D * t#) / (total + {DOCUMENT_PRIOR}D)"
        raw = own.selectExpr(*fixed, "if(seed, 1D, total / (n_passages + 1)) as weight", *self.each(f"greatest({share} * m#, 1e-3D * m#)", "p"))
        return raw.selectExpr("*", f"{self.total('p#')} as total").selectExpr(*fixed, "weight", *self.each("p# / total", "p"))

    def _named(self, rows: DataFrame, cells: DataFrame, place: DataFrame, nodes: DataFrame) -> DataFrame:
        """(doc, s, active, q*, agree): the shares of every passage, and how far they agree with its document's."""
        near = place.selectExpr("doc", "weight", *self.each("m#", "m"), *self.each("p# + 0.01D", "p"))
        shares = self._shared(cells, near, nodes).join(near.selectExpr("doc", *self.each("p#", "d")), "doc")
        told = shares.selectExpr("doc", "node", "reach > 0.5 as active", f"{self.total('y# * d#')} as agree", *self.each("y#", "q"))
        return rows.join(told, ["doc", "node"]).drop("node")

    def spread(self, docs: DataFrame, key: str, text: str, lang: str, hint: str | None, seeds: DataFrame, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
        """(passages, all): (doc, s, active, q*, agree) after the last round, and all passages with all their terms."""
        last = self.n[-1]
        own = docs.filter(F.col(key).isNotNull())
        full = stored(sentences(own, key, text, hint))
        held = [F.array_contains("seeds", s.lower()).cast("double") for s in self.subjects]
        named = F.size("seeds") > 0
        masks = [F.coalesce(x, F.lit(1.0)) for x in held] + [F.when(named, PLAIN).otherwise(1.0)]
        state = stored(
            own.select(F.col(key).alias("doc"), F.lower(F.trim(lang)).alias("lang"))
            .join(seeds, "doc", "left")
            .select("doc", "lang", F.col("seeds").isNotNull().alias("seed"), F.coalesce("trusted", F.lit(False)).alias("trusted"), *[x.alias(f"m{c}") for c, x in zip(self.n, masks)])
        )
        # the terms of the first graph lean by the seeds alone: in equal parts to a document's subjects
        of = state.filter("seed").selectExpr("doc", "lang", *self.each("m#", "m")).withColumn(f"m{last}", F.when(F.col(f"m{last}") < 1, 0.0).otherwise(1.0))
        sown = of.selectExpr("doc", "lang", *self.each(f"m# / {self.total('m#')}", "q"))
        first = full.join(sown.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).join(sown, "doc")
        content = self._content(first, sown)
        for graph, n_rounds in enumerate(rounds):
            rows, _, edges = self.similarity(full, content)
            degree = edges.groupBy("src").agg(F.sum("overlap").alias("d"))
            edges = stored(edges.join(degree, "src").select("src", "dst", (F.col("overlap") / (1 + F.col("d"))).alias("part")))
            cells = stored(rows.groupBy("doc", "node").agg(F.count("*").alias("n")))
            counts = cells.groupBy("doc").agg(F.sum("n").alias("n_passages"))
            place = stored(state.join(counts, "doc").selectExpr("*", f"{self.total('m#')} as total").selectExpr(*state.columns, "n_passages", "cast(seed as double) as weight", *self.each("m# / total", "p")))
            nodes = None
            for _ in range(n_rounds):
                heard = place.filter("seed") if nodes is None else place
                nodes, prior = self._sent(self._shared(cells, heard, nodes), edges)
                place = stored(self._documents(self._shared(cells, place, nodes), place, prior))
            if graph + 1 < len(rounds):
                live = place.filter(F.col("weight") > HEARD)
                told = self._named(rows, cells, live, nodes).filter("active").drop("active", "agree")
                # passages that weren't reached speak about what their document does; a labelled one's, rather about those of its subjects that few others do
                rest = "m# * (1 - 0.8D * p#)"
                mine = live.selectExpr("*", f"{self.total(rest)} as total").selectExpr("doc", "lang", *self.each(f"if(seed, {rest} / total, p#)", "p"))
                known = full.join(mine, "doc").join(told, ["doc", "s"], "left").selectExpr("lang", "terms", *self.each("cast(coalesce(q#, p#) as float)", "q"))
                content = self._content(known, live.selectExpr("lang", *self.each("p#", "q")))
        # seeds of one annotator may be wrong or incomplete: at last only trusted ones bind their document
        place = place.selectExpr("doc", "lang", "seed", "trusted", "n_passages", "weight", *self.each("if(seed and not trusted, 1D, m#)", "m"), *self.each("if(seed and not trusted, 1D, p#)", "p"))
        place = stored(self._documents(self._shared(cells, place, nodes), place, prior))
        self.content = content
        return stored(self._named(rows, cells, place, nodes)), full

    def subjects_of(self, labelled: DataFrame, full: DataFrame, least: int = 2) -> DataFrame:
        """(doc, subject, n_sentences): subjects with `least` or more sentences that clearly speak about them.

        Sentences with a word beside which sentences seldom agree with the rest of
        their document are left out: comparisons and other asides.
        """
        names = F.array(*[F.lit(x) for x in self.subjects], F.lit(None))  # the last column is no subject
        shares = F.array(*self.cols("q"))
        spoken = labelled.filter("active and s >= 0").select("doc", "s", "agree", shares.alias("shares")).withColumn("top", F.array_max("shares"))
        clear = spoken.select("doc", "s", "agree", "top", F.get(names, (F.array_position("shares", F.col("top")) - 1).cast("int")).alias("subject"))
        words = clear.select("doc", "s", "agree").join(full, ["doc", "s"]).select("doc", "s", "agree", F.explode("terms").alias("term"))
        plain = words.join(broadcast_if_small(self.content), "term", "left_anti")
        agreement = (F.sum("agree") + 0.7 * AGREEMENT_SENTENCES) / (F.count("*") + AGREEMENT_SENTENCES)
        odd = plain.groupBy("term").agg(agreement.alias("r"), F.count("*").alias("n")).filter((F.col("n") >= AGREEMENT_SENTENCES) & (F.col("r") < AGREEMENT)).select("term")
        aside = full.select("doc", "s", F.explode("terms").alias("term")).join(broadcast_if_small(odd), "term", "left_semi").select("doc", "s").distinct()
        return (
            clear.filter((F.col("top") >= CONFIDENT) & F.col("subject").isNotNull())
            .join(aside, ["doc", "s"], "left_anti")
            .groupBy("doc", "subject")
            .agg(F.count("*").alias("n_sentences"))
            .filter(F.col("n_sentences") >= least)
        )
