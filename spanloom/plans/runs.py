"""Configs to runs: validation, sweeps over list-valued parameters, names, dry runs and failure listing."""

from __future__ import annotations

import fnmatch
import inspect
import itertools
import re
from collections.abc import Callable, Collection, Iterable, Sequence

from pyspark.sql import functions as F

from ..functions import providers
from ..operators import augmentation, chunking, semantic

CHUNKERS: dict[str, Callable] = {
    "fixed_char": chunking.fixed_char,
    "fixed_token": chunking.fixed_token,
    "sentence": lambda docs, max_tokens=256, overlap=0: chunking.by_document(docs, lambda t: chunking.sentence_chunks(t, max_tokens, chunking.resolve_overlap(overlap, max_tokens))),
    "markdown": chunking.markdown_sections,
    "html": lambda docs, max_tokens=None: chunking.html_sections(docs.select("doc_id", F.col("text").alias("html")), "doc_id", max_tokens),
    "boundary": chunking.boundary_chunks,
    "semantic": semantic.semantic,
    "tiled": semantic.tiled,
    "clustered": semantic.clustered,
}
AUGMENTERS: dict[str, Callable] = {
    "title": augmentation.with_titles,
    "doc_summary": augmentation.with_document_summaries,
    "context": augmentation.with_context,
    "keywords": augmentation.with_keywords,
    "questions": augmentation.with_questions,
    "summary": augmentation.with_summaries,
}
#: Embedding and reranking models by the name that a config gives them.
EMBEDDERS: dict[str, Callable] = {"hashed_words": providers.hashed_words}
RERANKERS: dict[str, Callable] = {"lexical_overlap": providers.lexical_overlap}
RETRIEVERS = ("sparse", "dense", "hybrid")
#: The rendering that a chunker reads if its entry names none.
READS = {"markdown": "md", "html": "html"}
#: Parameters of chunkers that are no settings: tables and models.
SUPPLIED = ("docs", "embed", "ask", "tokens")


def as_list(value) -> list:
    """A text as a list of itself, nothing as an empty list."""
    return [value] if isinstance(value, str) else list(value or ())


def is_none(method) -> bool:
    """Whether a config's entry stands for leaving the step out."""
    return not method or method == "none"


def check_keys(entry: dict, allowed: Iterable[str], where: str) -> None:
    """A key that nothing reads is an error; a description may stand anywhere."""
    if extra := sorted(entry.keys() - {*allowed, "description"}):
        raise ValueError(f"{where} has keys that nothing reads: {', '.join(extra)}")


def sweep(params: dict, fixed: Sequence[str] = ()) -> list[dict]:
    """Every combination of list-valued parameters, other than the fixed ones."""
    names = list(params)
    choices = [[params[n]] if n in fixed or not isinstance(params[n], list) else params[n] for n in names]
    return [dict(zip(names, c)) for c in itertools.product(*choices)]


def run_name(method: str, params: dict | None = None) -> str:
    """``method-key=value-...`` with sorted keys, file-safe."""
    parts = [method, *(f"{k}={v}" for k, v in sorted((params or {}).items()))]
    return re.sub(r"[^\w.=+-]", "_", "-".join(parts))


def _choice(value, known: Collection[str], what: str, where: str):
    if value not in known:
        raise ValueError(f"{where}: {what} {value!r} is none of {', '.join(known)}")
    return value


def chunking_options(entry: dict, where: str) -> list[dict]:
    """Validated runs of one ``{method, params, rendering}`` entry, parameters left out filled in.

    ``params.embedding_model`` names the model of a chunker that embeds.  A combination whose overlap is not below its
    size is left out."""
    check_keys(entry, ("method", "params", "rendering"), where)
    method = _choice(entry.get("method"), CHUNKERS, "chunker", where)
    rendering = _choice(entry.get("rendering") or READS.get(method, "txt"), ("txt", "md", "html"), "rendering", where)
    accepted = inspect.signature(CHUNKERS[method]).parameters
    defaults = {k: p.default for k, p in accepted.items() if k not in SUPPLIED}
    if "embed" in accepted:
        defaults["embedding_model"] = next(iter(EMBEDDERS))
    given = entry.get("params", {})
    check_keys(given, defaults, f"{where}.params")
    out = []
    for chosen in sweep(given):
        full = defaults | chosen
        size, overlap = full.get("size", full.get("max_tokens")), full.get("overlap")
        if isinstance(size, int) and isinstance(overlap, int) and overlap >= size:
            continue
        if "embed" in accepted:
            _choice(full["embedding_model"], EMBEDDERS, "embedding model", where)
        out.append({"method": method, "params": full, "rendering": rendering, "name": run_name(method, chosen)})
    return out


def retrieval_options(entry: dict, where: str) -> list[dict]:
    """Validated ``{method, top_k, name}`` of one retrieval entry, swept over ``params.top_k``."""
    check_keys(entry, ("method", "params"), where)
    method = _choice(entry.get("method"), RETRIEVERS, "retrieval", where)
    check_keys(entry.get("params", {}), ("top_k",), f"{where}.params")
    made = [{"method": method, "top_k": p.get("top_k", 50)} for p in sweep(entry.get("params", {}))]
    return [{**o, "name": run_name(method, {"top_k": o["top_k"]})} for o in made]


def reranking_options(entry: dict, where: str) -> list[dict]:
    """Validated ``{model, top_k, name}`` of one reranking entry ``{method: cross_encoder, params}``."""
    check_keys(entry, ("method", "params"), where)
    _choice(entry.get("method"), ("cross_encoder",), "reranking", where)
    check_keys(entry.get("params", {}), ("model", "top_k"), f"{where}.params")
    made = [{"model": _choice(p.get("model"), RERANKERS, "model", where), "top_k": p.get("top_k", 50)} for p in sweep(entry.get("params", {}))]
    return [{**o, "name": run_name(o["model"], {"top_k": o["top_k"]})} for o in made]


def plan(config: dict, where: str = "config", renderings: Callable[[str], Collection[str]] = lambda dataset: ("txt", "md", "html")) -> list[dict]:
    """All runs of a config: datasets by chunkers by sets of augmentations, each with what to index and ask it with.

    A dataset that lacks a chunker's rendering is passed over; two settings that would share a folder are an error, as is
    a config that leaves no run."""
    stages = {"embeddings": lambda e, w: [_choice(e, EMBEDDERS, "embedding model", w)], "retrieval": retrieval_options, "reranking": reranking_options}
    check_keys(config, ("datasets", "chunking", "augmentations", *stages), where)
    expand = lambda stage, options: [o for i, e in enumerate(as_list(config.get(stage))) for o in options(e, f"{where}.{stage}[{i}]")]
    chunkers = expand("chunking", chunking_options)
    later = {stage: expand(stage, options) for stage, options in stages.items()}
    sets = [[] if is_none(a) else sorted(as_list(a), key=lambda x: list(AUGMENTERS).index(_choice(x, AUGMENTERS, "augmentation", where))) for a in config.get("augmentations", [None])]
    made: dict[str, dict] = {}
    for d, c, a in itertools.product(as_list(config["datasets"]), chunkers, sets):
        if c["rendering"] not in renderings(d):
            continue
        run = {"dataset": d, **c, "augmentations": a, "directory": "/".join([d, c["rendering"], c["name"], "+".join(a) or "plain"]), **later}
        if made.setdefault(run["directory"], run) != run:
            raise ValueError(f"{where}: two runs share {run['directory']}")
    if not made:
        raise ValueError(f"{where}: no run is left")
    return list(made.values())


def fingerprint(run: dict) -> dict:
    """What decides a run's chunks, every parameter spelled out: a default that changes later is another run."""
    return {k: run[k] for k in ("dataset", "rendering", "method", "params", "augmentations")}


def resolve(known: Sequence[str], targets) -> list[str]:
    """Known run folders that are named, globbed or ``all``; order kept, no repeats.  A target that selects none is an
    error, whatever the others select."""
    out: dict[str, None] = {}
    for t in as_list(targets):
        hits = [k for k in known if t == "all" or fnmatch.fnmatchcase(k, t)]
        if not hits:
            raise ValueError(f"no run matches {t!r}")
        out |= dict.fromkeys(hits)
    return list(out)


def run_each(runs: Sequence[dict], run: Callable[[dict], None], dry_run: bool = False, keep_going: bool = False) -> None:
    """Runs in turn.  The first failure is raised at once or, with ``keep_going``, all of them together at the end."""
    failed: list[Exception] = []
    for r in () if dry_run else runs:
        try:
            run(r)
        except Exception as e:
            if not keep_going:
                raise
            e.add_note(f"in {r['directory']}")
            failed.append(e)
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(runs)} runs failed", failed)
