"""The three jobs: export to archive, messages to insights, messages to the interaction report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from talkloom.functions import contents, fields, text as T
from talkloom.functions.lexicon import DEFAULT, Lexicon
from talkloom.operators import highlights, interaction, messages as M, rollups, terms
from talkloom.session import checkpointed
from talkloom.sources.archive import one_list


def tree_messages(
    trees: DataFrame, whole_tree: bool = False, keep_hidden: bool = False, keep_system: bool = False,
    keep_metadata: bool = False, key: str = "conv_id"
) -> DataFrame:
    """key, msg_pos, role, role_label, ts, body of a tree export's active branches (or of all nodes): what a reader sees."""
    if whole_tree:
        rows = M.all_nodes(trees, key)
    else:
        nodes = trees.select(key, F.explode("mapping").alias("node_id", "node"))
        rows = M.linear_path(trees, key).join(nodes, [key, "node_id"]).select(
            key, "node_id", "msg_pos", F.col("node.message").alias("message")
        ).where("message is not null")
    m = F.col("message")
    ts = F.when(m["create_time"] != 0, F.timestamp_seconds(m["create_time"]))
    shown = rows.select(
        key, "msg_pos", fields.or_else(m["author"]["role"], F.lit("unknown")).alias("role"), m["author"]["name"].alias("name"), ts.alias("ts"),
        m["metadata"]["is_visually_hidden_from_conversation"].alias("hidden"), contents.content_type(m["content"]).alias("content_type"), contents.rendered(m["content"], keep_metadata).alias("body"),
    )
    shown = shown if keep_hidden else M.drop_hidden(shown)
    shown = shown if keep_system else M.drop_system(shown)
    shown = shown if keep_metadata else M.drop_metadata_types(shown)
    kept = M.drop_tool_calls(M.drop_blank(shown))
    return kept.select(
        key, "msg_pos", "role", fields.role_label(F.col("role"), F.col("name"), F.col("ts")).alias("role_label"), "ts",
        "body"
    )


def generic_messages(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, msg_pos, role, role_label, ts, body of a flat export's conversations."""
    rows = M.explode_messages(convs.select(key, "messages"))
    m = F.col("message")
    content = F.coalesce(F.when(m["content"] != "null", m["content"]), m["text"])
    ts = fields.to_time(fields.or_else(m["created_utc"], m["created_at"]))
    read = rows.select(
        key, "msg_pos", fields.or_else(T.strip(m["role"]), F.lit("unknown")).alias("role"), ts.alias("ts"),
        contents.content_text(content).alias("body")
    )
    kept = M.drop_tool_calls(M.drop_blank(read))
    return kept.select(
        key, "msg_pos", "role", fields.role_label(F.col("role"), None, F.col("ts")).alias("role_label"), "ts",
        T.strip(F.col("body")).alias("body")
    )


def build_archive(convs: DataFrame, messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """The conversations table: convs (key, index, title, id, created, updated) with messages and file."""
    counted = M.message_counts(convs, messages, key)
    return counted.withColumn(
        "file",
        F.concat(
            F.lit("conversations/"),
            fields.archive_file_name(F.col("index"), F.col("created"), F.col("title"), F.col("id"))
        )
    )


@dataclass
class Insights:
    """What the archive is about. Term counts are computed once and kept in the shared folder; the rest is lazy.

    messages: conv_id, msg_pos, role, body; convs: conv_id, index, title, created, updated, messages, file.
    """

    messages: DataFrame
    convs: DataFrame
    lexicon: Lexicon = DEFAULT
    search_chars: int = 0
    snippet_chars: int = 240

    @cached_property
    def n(self) -> int:
        return self.convs.count()

    @cached_property
    def texts(self) -> DataFrame:
        return self.convs.select("conv_id", "index", "title").join(
            M.extract_text(self.messages), "conv_id", "left"
        ).withColumn("text", F.coalesce("text", F.lit("")))

    @cached_property
    def docs(self) -> DataFrame:
        return checkpointed(
            self.texts.select("conv_id", "index", terms.term_text(F.col("title"), F.col("text")).alias("text"))
        )

    @cached_property
    def vocab(self) -> DataFrame:
        return checkpointed(terms.han_vocab(self.docs, self.n, lexicon=self.lexicon))

    @cached_property
    def tokens(self) -> DataFrame:
        return terms.tokenize(self.docs, self.vocab, ["conv_id", "index"], self.lexicon)

    @cached_property
    def tf(self) -> DataFrame:
        return checkpointed(terms.term_counts(self.tokens, ["conv_id", "index"]))

    @cached_property
    def df(self) -> DataFrame:
        return checkpointed(terms.doc_freq(self.tf))

    @cached_property
    def keywords(self) -> DataFrame:
        return checkpointed(terms.tfidf_keywords(self.tf, self.df, self.n, ["conv_id"], lexicon=self.lexicon))

    @cached_property
    def topics(self) -> DataFrame:
        return terms.topic_labels(self.convs, self.tf, self.keywords, self.n, lexicon=self.lexicon)

    @cached_property
    def hot(self) -> DataFrame:
        return terms.hot_terms(self.df, self.n, lexicon=self.lexicon)

    @cached_property
    def search(self) -> DataFrame:
        """index, file, title, search_text."""
        found = self.convs.select("conv_id", "index", "file", "title").join(
            M.search_text(self.messages, self.search_chars), "conv_id", "left"
        )
        return found.select("index", "file", "title", F.coalesce("search_text", F.lit("")).alias("search_text"))

    @cached_property
    def items(self) -> DataFrame:
        listed = lambda df, c, name: df.groupBy("conv_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(name)
        )
        none = F.array().cast("array<string>")
        snippets = self.texts.select("conv_id", T.snippet(F.col("text"), self.snippet_chars).alias("snippet"))
        joined = self.convs.join(snippets, "conv_id").join(
            listed(self.keywords, "term", "keywords"), "conv_id", "left"
        ).join(
            listed(highlights.highlights(self.messages), "line", "highlights"), "conv_id", "left"
        ).join(self.topics, "conv_id")
        return joined.withColumns(
            {"keywords": F.coalesce("keywords", none), "highlights": F.coalesce("highlights", none)}
        )

    def report(self) -> DataFrame:
        """One row for the archive's front page: total, months, hot terms, topics."""
        parts = [
            one_list(rollups.month_counts(self.convs), "month_counts", ["month"]),
            one_list(self.hot, "top_keywords", ["rank"]),
            one_list(rollups.topic_counts(self.convs.join(self.topics, "conv_id")), "clusters", ["rank"])
        ]
        whole = self.convs.agg(F.count("*").alias("total"))
        for part in parts:
            whole = whole.crossJoin(part)  # each side is one row
        return whole


@dataclass
class InteractionReport:
    """How users talk with assistants. messages: conv_id, index, msg_pos, role, body; items: Insights.items or the like."""

    messages: DataFrame
    items: DataFrame | None = None

    @cached_property
    def features(self) -> DataFrame:
        return checkpointed(interaction.turn_features(interaction.cleaned_turns(self.messages)))

    @cached_property
    def scores(self) -> DataFrame:
        return interaction.conversation_scores(self.features, ["conv_id", "index"])

    @cached_property
    def summary(self) -> DataFrame:
        return interaction.interaction_summary(interaction.interaction_totals(self.features))

    @cached_property
    def quotes(self) -> DataFrame:
        return interaction.report_quotes(checkpointed(interaction.quote_buckets(self.features)))

    def parts(self) -> dict[str, DataFrame]:
        found = {
            "summary": self.summary, "strengths": interaction.strengths(self.summary),
            "gaps": interaction.gaps(self.summary), "quotes": self.quotes,
            "boundaries": interaction.boundary_quotes(self.features)
        }
        if self.items is not None:
            found["cluster_trends"] = interaction.topic_trends(self.items, self.scores)
        return found
