"""Folder to chunk store in one run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from passagemill import options as opt
from passagemill import schemas
from passagemill.functions.vectors import check_metric
from passagemill.operators.chunking import BoundaryScorer, chunk_documents
from passagemill.operators.classify import LabelScorer, classify_zero_shot, label_table, skip_reason, with_status
from passagemill.operators.embedding import embed_hashed
from passagemill.operators.projection import project_2d, viz_points
from passagemill.session import delete_paths, materialize, recorded
from passagemill.sources import store as st
from passagemill.sources.documents import parse_errors, parse_listed, parts_of
from passagemill.sources.files import list_source_files
from passagemill.sources.structured import PdfExtractor


@dataclass
class IngestOptions:
    strategy: str = opt.DEFAULT_STRATEGY
    chunk_options: dict[str, Any] = field(default_factory=dict)
    boundary_scorer: BoundaryScorer | None = None
    pdf_extractor: PdfExtractor | None = None
    model: str = "hashed"
    dim: int = 64
    # Adds a ``vector`` column to chunks; the hashed embedding by default.
    embed: Callable[[DataFrame], DataFrame] | None = None
    metric: str | None = None
    enable_classification: bool = False
    # The built-in hashed scorer, a caller's function, or none.
    classifier: str | LabelScorer | None = "hashed"
    candidate_labels: list[str] | None = None
    multi_label: bool = True
    prepare_viz_data: bool = False
    overwrite: bool = False


def chunks_of_parts(parts: DataFrame, options: IngestOptions) -> DataFrame:
    """Parts through chunking, optional labels and embedding: one lazy chain."""
    chunks = chunk_documents(
        parts, options.strategy, scorer=options.boundary_scorer, **options.chunk_options
    )
    if options.enable_classification:
        labels = options.candidate_labels or opt.DEFAULT_LABELS
        reason = skip_reason(True, None if options.classifier is None else True, labels)
        if reason:
            chunks = with_status(chunks, reason)
        else:
            scorer = None if options.classifier == "hashed" else options.classifier
            chunks = classify_zero_shot(
                chunks, label_table(parts.sparkSession, labels), multi_label=options.multi_label, scorer=scorer
            )
    embedded = options.embed(chunks) if options.embed else embed_hashed(chunks, dim=options.dim)
    return schemas.conform(embedded, schemas.CHUNK_FIELDS)


def manifest_of(options: IngestOptions, source: str) -> dict[str, Any]:
    classifier = None
    if options.enable_classification and options.classifier is not None:
        classifier = options.classifier if isinstance(options.classifier, str) else "custom"
    shown = opt.strategy_options(options.strategy, **options.chunk_options)
    return st.build_manifest(
        model=options.model,
        dimension=None,
        metric=check_metric(options.metric),
        chunker=options.strategy,
        chunk_params=vars(shown),
        source=source,
        classifier=classifier,
        labels=(options.candidate_labels or opt.DEFAULT_LABELS) if options.enable_classification else None,
        config={"dim": options.dim, "overwrite": options.overwrite, "viz": options.prepare_viz_data},
    )


def run_ingest(spark: SparkSession, root: str, out: str, options: IngestOptions | None = None) -> bool:
    """Parse, cut, label, embed and store a folder. False if nothing came out.

    Parsed parts are written once, since both chunks and errors come from them;
    the rest is one pass into a new run of the store, which is committed with
    the list of its files. What was written on the way is deleted again.
    """
    options = options or IngestOptions()
    st.refuse_existing(spark, out, options.overwrite)
    with recorded() as paths:
        files = materialize(list_source_files(spark, root), "listing")
        parsed = materialize(parse_listed(files, pdf_extractor=options.pdf_extractor), "parsed")
        parts = parts_of(parsed)
        filled = not parts.isEmpty()
        if filled:
            chunks = st.write_store(
                chunks_of_parts(parts, options), manifest_of(options, root), out,
                overwrite=True, files=files, errors=parse_errors(parsed),
            )
            if options.prepare_viz_data:
                st.write_viz_points(viz_points(project_2d(chunks)), f"{out}/viz_points")
    delete_paths(spark, paths)
    return filled
