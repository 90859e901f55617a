"""Labelling with a model that the user brings: whole tiles, blocks, crops, rows, folders of files.

A model is a function ``xyz (N, 3) metres -> N whole numbers`` (or, for crops,
``-> (N, classes) probabilities``), or an object that workers load (``models``). It
runs once a group; only idx and coordinates travel to the groups, labels come
back by idx.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import audit_label_field, provenance_json
from ..functions.units import resolve_units, to_metres
from ..operators.blocks import block_voxels, last_block, sliding_blocks, with_unseen
from ..operators.labels import apply_codes, argmax_label, ensemble_mean_arrays, merge_labels, needs_upgrade
from ..operators.neighbors import placed_crops
from ..operators.points import assert_finite, localize, with_representatives
from ..operators.tiling import TileGrid, assign_pieces, assign_tiles, buffer_for, group_extents, in_group, plan_groups, plan_tiles, tile_grid
from ..session import checkpointed, grown, qualified
from ..sources import las
from ..sources.files import check_outputs, files_changed, list_files, refuse_waveforms
from ..sources.publishing import discard_staged, publish_staged
from .models import Model, need_of, sendable


def checked(labels, count: int) -> np.ndarray:
    """``labels`` if they are one whole number a point."""
    found = np.asarray(labels)
    if found.shape != (count,) or found.dtype.kind not in "iu":
        raise ValueError(f"the model must return one whole number for each of {count} points")
    return found


#: Points that a window shall hold at most where cuts can bring it there, however large the budget: what a task gives its model at once.
WINDOW = 2_000_000


def _grouped(assigned: DataFrame, group: list[str], model: Model) -> DataFrame:
    """(idx, label) of core points: the model sees a group's whole window."""
    model = sendable(model)

    def run(window: pa.Table) -> pa.Table:
        core = window.column("core").to_numpy()
        if not core.any():  # halo alone
            return pa.table({"idx": pa.array([], pa.int64()), "label": pa.array([], pa.int32())})
        labels = checked(model(np.stack([window.column(c).to_numpy() for c in "xyz"], axis=1).astype(float, copy=False)), len(core))
        return pa.table({"idx": window.column("idx").to_numpy()[core], "label": labels[core].astype("i4")})

    core = F.coalesce(F.expr("x >= x0 and x < x1 and y >= y0 and y < y1"), F.lit(False)).alias("core")
    return assigned.select(*group, "idx", "x", "y", "z", core).groupBy(*group).applyInArrow(run, "idx long, label int")


def label_tiles(points: DataFrame, grid: TileGrid, model: Model, buffer: float) -> DataFrame:
    """(idx, label): each tile labelled with its halo, cores kept. Groups are as large as windows; ``label_planned`` bounds them."""
    return _grouped(assign_tiles(points.select("idx", "x", "y", "z"), grid, buffer), ["tile_id"], model)


def label_pieces(points: DataFrame, pieces: DataFrame, model: Model, buffer: float, by: tuple[str, ...] = ()) -> DataFrame:
    """As label_tiles, for pieces (piece_id, x0, y0, x1, y1) of uneven size; with columns ``by``, points that differ in them never meet.

    Pieces that have the columns ``by`` hold only points equal in them.
    """
    shared = tuple(c for c in by if c in pieces.columns)
    return _grouped(assign_pieces(points.select("idx", "x", "y", "z", *by), pieces, buffer, shared), ["piece_id", *by], model)


def _in_budget(plan: DataFrame, budget: int, allow_over_budget: bool) -> DataFrame:
    pieces = checkpointed(plan.where("total > 0"))
    if not allow_over_budget:
        over = pieces.where(F.col("total") > budget).agg(F.count("*").alias("n"), F.max("total").alias("most")).first()
        if over["n"]:
            raise ValueError(f"{over['n']} windows stay over the budget of {budget} points, the fullest has {over['most']}; take a larger budget or a smaller buffer")
    return pieces.select(F.concat_ws("/", "tile_id", "path").alias("piece_id"), F.shiftright("tile_id", 32).alias("grid_id"), "x0", "y0", "x1", "y1")


def label_planned(points: DataFrame, grid: TileGrid, model: Model, buffer: float, budget: int, allow_over_budget: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(idx, label) by the tiles of ``grid``, cut and refined until no window holds more than ``budget`` points.

    A window that no cut can bring under the budget (more points than that
    within the buffer of each other) is an error, unless it is allowed. A
    window within a larger budget is cut to ``WINDOW`` points where cuts can.
    With columns ``by``, each group has tiles of that size of its own.
    """
    if by:
        return label_groups(points, by, model, buffer, budget, None, grid.size, allow_over_budget)
    return label_pieces(points, _in_budget(plan_tiles(points, grid, buffer, min(budget, WINDOW)), budget, allow_over_budget), model, buffer)


def label_groups(points: DataFrame, by: tuple[str, ...], model: Model, buffer: float, budget: int, target: int | None, size: float | None = None, allow_over_budget: bool = False) -> DataFrame:
    """(idx, label): as label_planned, each group of points equal in the columns ``by`` planned, counted against the budget and labelled by itself."""
    groups = checkpointed(group_extents(points, by))
    members = in_group(points, groups, by)
    pieces = _in_budget(plan_groups(members, groups, buffer, min(budget, WINDOW), target, size), budget, allow_over_budget)
    return label_pieces(members, pieces, model, buffer, ("grid_id",))


def label_rows(points: DataFrame, model: Model) -> DataFrame:
    """(idx, label) by a model that needs no neighbours, batch by batch. No shuffle."""
    model = sendable(model)

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"idx": frame.idx, "label": checked(model(frame[["x", "y", "z"]].to_numpy(float)), len(frame)).astype("i4")})

    return points.select("idx", "x", "y", "z").mapInPandas(run, "idx long, label int")


def label_blocks(points: DataFrame, model: Model, resolution: tuple[float, float, float], shape: tuple[int, int, int], overlap: float = 0.1, binary: bool = False, flat: bool = False) -> DataFrame:
    """(idx, label): overlapping blocks of ``shape`` voxels, occupancy given to the model.

    The model gets a block's occupied voxels (M, 3) and returns M labels. Of
    overlapping blocks the last wins; with ``binary`` a point is 2 where any
    block says more than 1. ``flat`` cuts blocks in x and y only; a binary
    point that no voxel grid holds then counts as 2. Else such a point is 0.
    """
    model, size = sendable(model), tuple(r * n for r, n in zip(resolution, shape, strict=True))
    members = sliding_blocks(points.select("idx", "x", "y", "z"), size[:2] if flat else size, overlap)
    voxel = ["block_id", "vi", "vj", "vk"]
    placed = block_voxels(members, resolution, shape).select("idx", *voxel)

    # voxels are made distinct before they meet, so a block has at most the voxels of its grid; blocks are small, so they come as sorted batches
    dealt = placed.select(*voxel).distinct().repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block_id").sortWithinPartitions(*voxel)
    labelled = dealt.mapInArrow(partial(_block_preds, model), "block_id long, vi long, vj long, vk long, pred int")
    votes = placed.join(grown(labelled), voxel).select("idx", "block_id", "pred")
    # one shuffle by idx, without the join that would sort cloud and votes
    if binary:
        told = with_unseen(votes.withColumn("pred", F.col("pred") > 1), points, F.lit(None).cast("boolean"))
        label = F.coalesce(F.bool_or("pred"), F.lit(flat)).cast("int") + 1
        return told.groupBy("idx").agg(label.alias("label"))
    return last_block(with_unseen(votes, points, F.lit(0))).select("idx", F.col("pred").alias("label"))


def _whole_crops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in which rows equal in their first column, center, follow each other, as tables of whole crops; held are one crop and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        centers = batch.column(0).to_numpy()
        other = np.flatnonzero(centers != centers[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (held and held[0].column(0)[0].as_py() != centers[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _crop_votes(model: Model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(idx, probs) of crops (center, idx, x, y, z), each crop's rows together in the order of idx: the model runs once a crop."""
    for table in _whole_crops(batches):
        centers, place = table.column("center").to_numpy(), np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1).astype(np.float32)
        bounds, found, widths = np.array([*np.flatnonzero(np.diff(centers, prepend=centers[0] - 1)), len(centers)]), [], []
        sizes, starts = np.diff(bounds), bounds[:-1]
        means = np.add.reduceat(place.astype(np.float64), starts, axis=0) / sizes[:, None]
        place -= np.repeat(means.astype(np.float32), sizes, axis=0)
        place[:, 2] -= np.repeat(np.minimum.reduceat(place[:, 2], starts), sizes)
        for start, end in pairwise(bounds.tolist()):
            probs = np.asarray(model(place[start:end]), np.float64)
            if probs.ndim != 2 or len(probs) != end - start:
                raise ValueError("the model must return finite probabilities, a row for each point")
            found.append(probs.ravel())
            widths.append(probs.shape[1])
        values = np.concatenate(found)
        if not np.isfinite(values).all():
            raise ValueError("the model must return finite probabilities, a row for each point")
        offsets = np.concatenate([[0], np.cumsum(np.repeat(widths, sizes))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([table.column("idx").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["idx", "probs"])


#: Votes that a task sums by point before it hands them on.
VOTES = 200_000


def _summed_votes(model: Model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(idx, probs, visits): ``_crop_votes``, those of crops that follow each other summed by point, so that fewer are shuffled."""
    held, n = [], 0
    for batch in _crop_votes(model, batches):
        held.append(batch)
        n += len(batch)
        if n >= VOTES:
            yield from _summed(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield from _summed(pa.Table.from_batches(held))


def _summed(votes: pa.Table) -> Iterator[pa.RecordBatch]:
    idx, probs = votes.column("idx").to_numpy(), votes.column("probs").combine_chunks()
    widths, values = np.diff(probs.offsets.to_numpy()), probs.flatten().to_numpy()
    for width in np.unique(widths).tolist():
        same = widths == width
        points, at, visits = np.unique(idx[same], return_inverse=True, return_counts=True)
        rows = values[np.repeat(same, widths)].reshape(-1, width)
        sums = np.stack([np.bincount(at, rows[:, c], len(points)) for c in range(width)], axis=1) if width else rows[:0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(points), lists, pa.array(visits)], ["idx", "probs", "visits"])


def _block_preds(model: Model, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block_id, vi, vj, vk) sorted by all, with pred: the model runs once a block."""
    for table in _whole_crops(batches):
        block, voxels = table.column("block_id").to_numpy(), np.stack([table.column(c).to_numpy() for c in ("vi", "vj", "vk")], axis=1)
        bounds = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]
        preds = [checked(model(voxels[start:end]), end - start).astype("i4") for start, end in pairwise(bounds)]
        yield from table.append_column("pred", pa.array(np.concatenate(preds))).to_batches()


def label_crops(points: DataFrame, model: Model, k: int, radius: float, spacing: float, grid: float) -> DataFrame:
    """(idx, label): voxel representatives labelled by overlapping crops, votes averaged, labels carried to every point.

    The model gets a crop's coordinates, less the centre of mass and above
    the lowest point, and returns (N, classes) probabilities.
    """
    model = sendable(model)
    projected = checkpointed(with_representatives(points.select("idx", *"xyz"), grid))
    cloud = localize(projected.where("idx = rep_idx").select("idx", *"xyz"))
    cloud = checkpointed(cloud.select("idx", *[F.col(f"l{c}").cast("double").alias(c) for c in "xyz"]))
    crops = placed_crops(cloud, k, radius, spacing)

    # by a stated number of partitions: rows are few beside the model's work, so partitions are not to be merged by size;
    # crops that lie together go to one, so that their votes on a point meet before the shuffle
    side = F.lit(2.0 * (spacing + radius))
    # one number, tile before crop, that tells most rows apart in a sort
    near = F.shiftleft(F.floor(F.col("cy") / side).bitwiseAND(0xFFFFF), 44).bitwiseOR(F.shiftleft(F.floor(F.col("cx") / side).bitwiseAND(0xFFFFF), 24))
    members = crops.select(near.bitwiseOR(F.xxhash64("center").bitwiseAND(0xFFFFFF)).alias("_crop"), "center", "idx", *"xyz")
    dealt = members.repartitionByRange(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_crop", "center").sortWithinPartitions("_crop", "center", "idx")
    votes = dealt.select("center", "idx", *"xyz").mapInArrow(partial(_summed_votes, model), "idx long, probs array<double>, visits long")
    labels = ensemble_mean_arrays(votes).select(F.col("idx").alias("rep_idx"), argmax_label(F.col("probs")).alias("label"))
    return projected.select("idx", "rep_idx").join(grown(labels), "rep_idx").select("idx", "label")


def point_codes(points: DataFrame, model: Model, classes: DataFrame, *, tile_size: float | None = None, target: int = 1_000_000, budget: int | None = None, buffer: float | None = None, need: float | None = None,
                raw_ids: bool = False, allow_over_budget: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(idx, label): the code of each point's label, by ``classify``'s plan; several points of one idx fail the job."""
    halo, most = buffer_for(buffer, need_of(model, need)), budget or 4 * target
    if by:
        labels = label_groups(points, by, model, halo, most, target, tile_size, allow_over_budget)
    else:
        labels = label_planned(points, tile_grid(points, target, tile_size), model, halo, most, allow_over_budget)
    codes = apply_codes(labels, classes, raw_ids)
    # one row an idx, by the shuffle that the join needs anyway
    single = codes.groupBy("idx").agg(F.min("code").alias("label"), F.count("*").alias("_times"))
    several = F.raise_error(F.concat(F.lit("several points have idx "), F.col("idx").cast("string"))).cast("short")
    return single.select("idx", F.when(F.col("_times") == 1, F.col("label")).otherwise(several).alias("label"))


def with_codes(points: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """``points`` with ``column``, the codes; a point without one fails the job."""
    missing = F.raise_error(F.concat(F.lit("no label for point "), F.col("idx").cast("string"))).cast("short")
    merged = merge_labels(points, codes, column)
    return merged.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(missing))


def classify(points: DataFrame, model: Model, classes: DataFrame, *, column: str = "classification", **options) -> DataFrame:
    """``points`` with ``column``: tiles planned, dense ones cut, labelled with halos, merged by idx and mapped to codes.

    Options are those of ``point_codes``. The halo is ``need``, what the model
    looks at around a point (by default its own ``context_buffer_m``), or
    ``buffer`` if that is more (``buffer_for``). Tiles hold about ``target``
    points where density is even; a window of more than ``budget`` (by default
    four times the target) is cut, so that no group of the model outgrows a
    worker; so is one of more than ``WINDOW`` points within a larger budget,
    where a cut helps. Columns ``by`` tell groups apart, as files, that are planned and
    labelled each by itself. ``column`` may exist already and is then replaced.
    An unmapped label, a point without a label and an idx that several points
    share fail the job.
    """
    return with_codes(points, point_codes(points, model, classes, **options), column)


def check_run(heads: DataFrame, result: str, field: str, suffix: str) -> str:
    """The name of the label field, if nothing speaks against a run: no result over an input or over another, and a field that all files can take.

    One job over the headers; it fails before any label is made.
    """
    plan = planned_files(heads).select("path", F.concat(F.lit(f"{result.rstrip('/')}/"), result_name(suffix)).alias("out"))
    wrong = check_outputs(plan).select(F.concat("out", F.lit(": "), "reason").alias("error"))
    dims = heads.select(F.col("path").alias("file_id"), F.explode_outer("dims").alias("d")).select("file_id", "d.*")
    audit = audit_label_field(dims, field)
    unfit = audit.where("error is not null").select(F.concat("file_id", F.lit(": label field "), "field", F.lit(" "), "error").alias("error"))
    for bad in wrong.unionByName(unfit).orderBy("error").limit(1).collect():
        raise ValueError(bad.error)
    name = (field or "").strip() or "classification"
    name = "classification" if name.lower() == "classification" else name
    if name.lower() in {*las.OWN, *las.RAW.values()}:
        raise ValueError(f"label field {name}: every read has a column of that name")
    return name


def classify_files(spark: SparkSession, source: str, result: str, model: Model, classes: DataFrame, *, crs_units: DataFrame | None = None, override: str = "auto", field: str = "classification",
                   suffix: str = "_classified", model_name: str = "", weights: str = "", **options) -> DataFrame:
    """Labels every LAS file of ``source`` and writes it to ``result``; (path, out, declared_count, n_out), a row a file.

    The whole way: headers scanned; files refused that cannot be read, hold
    waveforms or degrees; results that would replace an input or each other,
    and a label field that a file cannot take, refused; units resolved
    (``override``: metre, foot, us_foot or auto; ``crs_units`` (code, to_m) for
    GeoTIFF keys that name a system) and coordinates brought to metres and
    checked; each file planned and labelled by itself (``options`` as of
    ``classify``); formats upgraded if a code needs it; files written with all
    they had, provenance of other fields included; inputs compared with what
    they were before; results published together; counts compared with the
    sources'. ``field`` is classification, with the classes' codes, or the
    name of a dimension for the model's own class numbers, which is added
    where a file lacks it and replaced where it has it.
    """
    before = checkpointed(list_files(spark, source))
    heads = checkpointed(las.scan_headers(spark, source))
    for bad in heads.where("warning is not null").orderBy("path").limit(1).collect():
        raise ValueError(bad.warning)
    known = spark.createDataFrame([], "code int, to_m double") if crs_units is None else crs_units
    resolved = resolve_units(heads.withColumn("override", F.lit(override)), known)
    files = checkpointed(refuse_waveforms(resolved).select("path", "declared_count", "point_format", "xy_to_m", "z_to_m"))
    field = check_run(heads, qualified(spark, result), field, suffix)
    options.setdefault("raw_ids", field != "classification")
    place = las.read_points(spark, source, columns=["idx", "path", "x", "y", "z"])
    codes = checkpointed(point_codes(assert_finite(to_metres(place, files, key="path", kept=None)), model, classes, by=("path",), **options))
    labelled = with_codes(las.read_points(spark, source), codes, field)
    oldest = files.agg(F.min("point_format")).first()[0]
    upgrade = field == "classification" and oldest is not None and needs_upgrade(codes.select(F.col("label").alias("code")), oldest).first()["needs_upgrade"]
    named = classes.select("model_id", "asprs_code", F.col("name") if "name" in classes.columns else F.lit("").alias("name"))
    table = named.agg(F.collect_list(F.struct(F.col("model_id").alias("id"), "name", F.col("asprs_code").alias("asprs"))).alias("c"))  # at most 256 classes
    record = table.select(provenance_json(F.lit(model_name), F.lit(weights), F.lit(field), F.col("c"))).first()[0]
    stage = uuid.uuid4().hex
    las.write_copies(labelled, result, field, upgrade, suffix, record, stage=stage)
    at = qualified(spark, result)
    for changed in files_changed(before, list_files(spark, source)).orderBy("path").limit(1).collect():
        discard_staged(at, stage)
        raise ValueError(f"{changed.path} changed during the run; nothing was published")
    publish_staged(at, stage)
    return written_counts(files, las.scan_headers(spark, result), suffix)


def planned_files(files: DataFrame) -> DataFrame:
    """(path, declared_count, several, k): a row for each file that a source of ``files`` is written to."""
    several = F.col("declared_count") > las.PART
    parts = F.expr(f"sequence(0L, greatest(declared_count - 1, 0L) div {las.PART}L)")
    return files.select("path", "declared_count", several.alias("several"), F.explode(parts).alias("k"))


def result_name(suffix: str):
    """Name of the file for a row of ``planned_files``."""
    stem = F.concat(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.lit(suffix))
    return F.concat(stem, F.when(F.col("several"), F.format_string("-%05d", "k")).otherwise(""), F.lit(".las"))


def written_counts(files: DataFrame, heads: DataFrame, suffix: str) -> DataFrame:
    """(path, out, declared_count, n_out) of each file; one whose results have another number of points fails the job."""
    wanted = planned_files(files).select("path", "declared_count", result_name(suffix).alias("name"))
    found = heads.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("path").alias("out"), F.col("declared_count").alias("n"))
    totals = wanted.join(found, "name", "left").groupBy("path", "declared_count").agg(F.min("out").alias("out"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_out"))
    wrong = F.raise_error(F.concat("path", F.lit(": not all points were written"))).cast("long")
    return totals.select("path", "out", "declared_count", F.when(F.col("n_out") == F.col("declared_count"), F.col("n_out")).otherwise(wrong).alias("n_out"))
