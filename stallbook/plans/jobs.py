"""Composed jobs: profile extraction, embedding report, tagger score."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallbook.operators import clustering, evaluation, messages, pairing, summaries, tag_counts, text_clusters, tfidf, vectors
from stallbook.schemas import MESSAGE_KEY
from stallbook.scratch import stored
from stallbook.sources import profiles


def extract_profiles(annotated: DataFrame) -> dict[str, DataFrame]:
    """All profile tables of annotated messages (chat_id, message_id, user, ts, ts_local, text, spans, relations)."""
    visible = messages.non_blank(annotated)
    entities = messages.named_entities(visible)
    mentions = pairing.nearest_price(entities)
    users = messages.users_of(annotated)
    times = summaries.post_times(annotated)
    return {
        "entities": entities,
        "relations": messages.relation_rows(visible),
        "products": mentions,
        "locations": messages.locations(entities),
        "persons": messages.persons(entities),
        "payments": messages.payment_methods(entities),
        "summary": summaries.summaries(mentions, entities, times, users),
    }


def profile_components(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings of the extraction as one table with the kind in `name`."""
    entity = F.struct("label", "text", "start", "end")
    empty = {name: F.lit(None).cast(kind) for name, kind in profiles.FINDINGS.items()}
    no_message = [F.lit(None).cast(kind).alias(name) for name, kind in zip(MESSAGE_KEY, ("string", "long"), strict=True)]

    def part(df: DataFrame, name: str, message=tuple(MESSAGE_KEY), **found) -> DataFrame:
        columns = [c.cast(profiles.FINDINGS[f]).alias(f) for f, c in (empty | found).items()]
        return df.select("user", F.lit(name).alias("name"), *message, *columns)

    price = F.when(
        F.col("price_text").isNotNull(),
        F.struct(
            F.lit("MONEY").alias("label"),
            F.col("price_text").alias("text"),
            F.col("price_start").alias("start"),
            F.col("price_end").alias("end"),
        ),
    )
    return (
        part(tables["entities"], "named_entity", entity=entity)
        .unionByName(part(tables["relations"], "relation", relation=F.struct("head", "tail", "label")))
        .unionByName(part(tables["products"].withColumn("label", F.lit("PROD")), "product", entity=entity, price=price))
        .unionByName(part(tables["locations"], "location", entity=entity))
        .unionByName(part(tables["persons"], "person", entity=entity))
        .unionByName(part(tables["payments"], "payment", entity=entity))
        .unionByName(part(tables["summary"], "summary", no_message, summary=F.struct(*summaries.COUNTS)))
    )


def components_of(components: DataFrame, name: str) -> DataFrame:
    return components.filter(F.col("name") == name)


def relations_of(components: DataFrame) -> DataFrame:
    """Relation rows of stored profiles, as the offers are made from."""
    return components_of(components, "relation").select("user", *MESSAGE_KEY, "relation.*")


def summaries_of(components: DataFrame) -> DataFrame:
    return components_of(components, "summary").select("user", "summary.*")


def summary_only(annotated: DataFrame) -> DataFrame:
    """Just the summary rows of the extraction: entities and times are read, relations and mentions by kind are not."""
    entities = messages.named_entities(messages.non_blank(annotated))
    return summaries.summaries(pairing.nearest_price(entities), entities, summaries.post_times(annotated), messages.users_of(annotated))


def embedding_report(class_vectors: DataFrame) -> DataFrame:
    """Silhouette, cohesion, affinity and difference cells of labelled vectors (id, class, vector) as one table."""
    affinity = vectors.affinity_matrix(class_vectors)
    rows = lambda df, table: df.select(F.lit(table).alias("table"), "class_a", "class_b", "value")
    score = clustering.silhouette(class_vectors).select(
        F.lit("all").alias("class_a"), F.lit("all").alias("class_b"), F.col("silhouette").alias("value")
    )
    return (
        rows(score, "silhouette")
        .unionByName(rows(affinity, "affinity"))
        .unionByName(rows(vectors.difference_table(affinity), "difference"))
    )


def score_tagger(docs: DataFrame, patterns: DataFrame, key: list[str]) -> DataFrame:
    """Dictionary tagger against the gold spans of the same documents, both as token ranges."""
    return evaluation.scores_of(*tag_counts.tag_counts(docs, patterns, key, contract=True, entities=True))


def cluster_tfidf(mentions: DataFrame, users: DataFrame, threshold: float, min_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Clusters (id, cluster_id) of all users by the character n-grams of the products they mention (user, text), and the clusters' names.

    `users` has user and a number id; a cluster is named by its smallest id. Users without products are -2, those in clusters of fewer than
    `min_size` are -1.
    """
    n = users.count()
    numbered = users.select("user", F.col("id").cast("long").alias("id"))
    words = stored(tfidf.profile_words(mentions), "profile_words")
    grams = tfidf.char_tfidf(words, n).join(numbered, "user")
    weights = stored(grams.select("id", F.col("gram").alias("term"), "weight"), "profile_grams")
    found = text_clusters.sparse_clusters(weights, threshold)
    clusters = stored(clustering.cluster_sizes(numbered.select("id").join(found, "id", "left"), min_size), "tfidf_clusters")
    offered = mentions.join(numbered, "user").select("id", F.col("text").alias("product")).distinct()
    product_words = tfidf.profile_words(mentions.select(F.col("text").alias("user"), "text").distinct())
    product_weights = tfidf.char_weights(product_words, words, n).select(F.col("user").alias("product"), F.col("gram").alias("term"), "weight")
    return clusters, text_clusters.sparse_cluster_names(clusters, weights, offered, product_weights)
