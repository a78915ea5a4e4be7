"""Initial voxel states from prior segmentations, and the clean-up around them.

A state row is ``i, j, k, cell, prior_cell, log_prior, log_1m_prior``; a NULL
cell is background. Voxels without a row are background without a prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.functions.offsets import VERTICAL, VON_NEUMANN, VON_NEUMANN_XY, Offset
from cellgrid.functions.scalar import affine_det, affine_x, logistic
from cellgrid.operators.grid import VOXEL, Grid, by_tile, neighbour_messages, tile_of
from cellgrid.operators.skew import dense_index, no_match
from cellgrid.session import materialize

STATE = [*VOXEL, "cell", "prior_cell", "log_prior", "log_1m_prior"]
PRIOR = ["prior_cell", "log_prior", "log_1m_prior"]


def _with_prior(df: DataFrame, p: Column) -> DataFrame:
    return df.withColumns({"log_prior": F.log(p), "log_1m_prior": F.log(F.lit(1.0) - p)})


def vote_winners(votes: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Candidate with the largest weight per key; ties go to the lowest cell."""
    best = F.min(F.struct((-F.col(weight)).alias("w"), F.col("cell").alias("cell"))).alias("b")
    return votes.groupBy(*keys).agg(best).select(*keys, F.col("b.cell").alias("cell"), (-F.col("b.w")).alias(weight))


def prior_votes(voxelized: DataFrame) -> DataFrame:
    """Molecules per (voxel, cell): all of the cell's, and its nuclear ones."""
    n = F.col("n")
    return (
        voxelized.where(F.col("cell").isNotNull())
        .groupBy(*VOXEL, "cell")
        .agg(F.sum(n).alias("n_cell"), F.coalesce(F.sum(F.when(F.col("nucleus").isNotNull(), n)), F.lit(0)).alias("n_nucleus"))
    )


def _rank_votes(votes: DataFrame) -> DataFrame:
    nuclear = F.when(F.col("n_nucleus") > 0, F.struct((-F.col("n_nucleus")).alias("w"), F.col("cell").alias("cell")))
    any_part = F.struct((-F.col("n_cell")).alias("w"), F.col("cell").alias("cell"))
    return votes.groupBy(*VOXEL).agg(F.min(nuclear).alias("nuc"), F.min(any_part).alias("any"))


def states_from_assignments(voxelized: DataFrame, nuclear_reassignment: float = 0.2, prior_reassignment: float = 0.5) -> DataFrame:
    """States by vote of the prior assignment of the molecules in each voxel.

    A voxel with nuclear molecules belongs to its nuclear winner. Elsewhere the
    winner among whole-cell votes is only a prior, and only if that cell won
    some nuclear voxel; other cells are dropped.
    """
    ranked = materialize(_rank_votes(prior_votes(voxelized)), "ranked")  # read three times below
    owned = ranked.where(F.col("nuc").isNotNull()).select(
        *VOXEL, F.col("nuc.cell").alias("cell"), F.col("nuc.cell").alias("prior_cell")
    )
    hinted = ranked.where(F.col("nuc").isNull()).select(*VOXEL, F.col("any.cell").alias("prior_cell"))
    hinted = hinted.join(owned.select(F.col("cell").alias("prior_cell")).distinct(), "prior_cell", "left_semi")
    owned = _with_prior(owned, F.lit(1.0 - nuclear_reassignment))
    hinted = _with_prior(hinted.withColumn("cell", F.lit(None).cast(owned.schema["cell"].dataType)), F.lit(1.0 - prior_reassignment))
    return owned.select(*STATE).unionByName(hinted.select(*STATE))


def used_cells(states: DataFrame) -> DataFrame:
    """Cells that own a voxel, with dense ids in key order."""
    return dense_index(states.where(F.col("cell").isNotNull()).select("cell"), ["cell"], "cell_id")


def recode_cells(states: DataFrame, index: DataFrame) -> DataFrame:
    """Replace cell keys by the dense ids of ``index(cell, cell_id)``."""
    own = index.select(F.col("cell").alias("prior_cell"), F.col("cell_id").alias("prior_id"))
    # prior_cell equals cell wherever cell is set, so one lookup serves both
    return states.join(own, "prior_cell", "left").select(
        *VOXEL,
        F.when(F.col("cell").isNotNull(), F.col("prior_id")).alias("cell"),
        F.col("prior_id").alias("prior_cell"),
        "log_prior", "log_1m_prior",
    )


def states_from_barcodes(
    mappings: DataFrame, positions: DataFrame, grid: Grid, z_mean: float,
    nuclear_reassignment: float = 0.2, order: str = "square_002um",
) -> DataFrame:
    """States from barcoded squares assigned to cells: the first nuclear square per voxel wins."""
    used = mappings.where(F.col("in_nucleus") & F.col("cell_id").isNotNull())
    placed = used.join(positions, used["square_002um"] == positions["barcode"])
    vox = placed.withColumns({"i": grid.i(F.col("x")), "j": grid.j(F.col("y")), "k": grid.k(F.lit(z_mean))})
    first = vox.groupBy(*VOXEL).agg(F.min_by("cell_id", F.col(order)).alias("cell"))
    return _with_prior(first.withColumn("prior_cell", F.col("cell")), F.lit(1.0 - nuclear_reassignment)).select(*STATE)


def unmatched_barcodes(mappings: DataFrame, positions: DataFrame) -> DataFrame:
    """Nuclear squares without a position; a non-empty result is an input error."""
    used = mappings.where(F.col("in_nucleus") & F.col("cell_id").isNotNull())
    return used.join(positions, used["square_002um"] == positions["barcode"], "left_anti")


def mask_votes(
    pixels: DataFrame, grid: Grid, x_transform: tuple[float, float, float], y_transform: tuple[float, float, float],
    layer: int, prior_reassignment: float = 0.5, discount: float = 0.85,
) -> DataFrame:
    """Weight of every (mask, frozen) label over the pixels that fall in a voxel.

    ``pixels`` holds ``row_px, col_px, mask_id`` of labelled pixels, optionally
    ``cellprob_logit`` and ``frozen`` (pixels of a fixed mask, weight 1).
    """
    px, py = F.col("col_px") + F.lit(0.5), F.col("row_px") + F.lit(0.5)
    at = pixels.withColumns({
        "i": grid.i(affine_x(x_transform, px, py)),
        "j": grid.j(affine_x(y_transform, px, py)),
        "k": F.lit(layer).cast("bigint"),
    })
    if "cellprob_logit" in pixels.columns:
        weight = F.lit(0.5) + F.lit(0.5 * discount) * logistic(F.col("cellprob_logit").cast("double"))
    else:
        weight = F.lit(1.0 - prior_reassignment)
    frozen = F.col("frozen") if "frozen" in pixels.columns else F.lit(False)
    weight = F.when(frozen, F.lit(1.0)).otherwise(weight)
    at = at.withColumns({"frozen": frozen, "weight": weight})
    return at.groupBy(*VOXEL, "mask_id", "frozen").agg(F.sum("weight").alias("weight"))


def states_from_masks(votes: DataFrame, grid: Grid, x_transform, y_transform, per_voxel: bool = True) -> DataFrame:
    """Heaviest label per voxel; its prior is the weight per pixel of the voxel, at most 0.99.

    ``per_voxel=False`` divides by pixels per square micron instead, which
    saturates the prior on voxels larger than one micron.
    """
    pixels = 1.0 / abs(affine_det(x_transform, y_transform))
    if per_voxel:
        pixels *= grid.voxel_size**2
    best = F.min(F.struct((-F.round("weight", 9)).alias("w"), F.col("mask_id"), F.col("frozen"))).alias("b")
    won = votes.groupBy(*VOXEL).agg(best)
    name = F.concat(F.col("b.mask_id").cast("string"), F.when(F.col("b.frozen"), F.lit("-fixed")).otherwise(F.lit("")))
    p = F.least(F.lit(0.99), -F.col("b.w") / F.lit(pixels))
    return _with_prior(won.withColumns({"cell": name, "prior_cell": name, "frozen": F.col("b.frozen")}), p).select(*STATE, "frozen")


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of each closed ring, paired by an equi join on the ordinal."""
    start = vertices.select("polygon", "vertex", F.col("x").alias("x1"), F.col("y").alias("y1"))
    end = vertices.select("polygon", (F.col("vertex") - 1).alias("vertex"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return start.join(end, ["polygon", "vertex"]).select("polygon", "x1", "y1", "x2", "y2")


def rasterize_polygons(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Voxel columns (i, j) whose centre lies strictly inside a ring; the last polygon wins.

    Scan conversion: an edge yields one crossing per grid row it spans, and the
    voxels between the odd and the even crossing of a row are inside. The
    shuffle carries crossings, never a bounding box of candidates.
    """
    vs = F.lit(grid.voxel_size)
    edges = polygon_edges(vertices)
    ylo, yhi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose centre yc satisfies ylo <= yc < yhi
    jlo = F.ceil((ylo - F.lit(grid.ymin)) / vs - F.lit(0.5)).cast("bigint")
    jhi = (F.ceil((yhi - F.lit(grid.ymin)) / vs - F.lit(0.5)) - 1).cast("bigint")
    rows = edges.where(jlo <= jhi).select("*", F.explode(F.sequence(jlo, jhi)).alias("j")).where("j >= 0")
    yc = grid.center_y(F.col("j"))
    cross_x = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.select("polygon", "j", cross_x.alias("xa"))
    w = Window.partitionBy("polygon", "j").orderBy("xa")
    spans = crossings.withColumns({"xb": F.lead("xa").over(w), "r": F.row_number().over(w)}).where("r % 2 = 1")
    ilo = F.greatest(F.lit(0), (F.floor((F.col("xa") - F.lit(grid.xmin)) / vs - F.lit(0.5)) + 1).cast("bigint"))
    ihi = (F.ceil((F.col("xb") - F.lit(grid.xmin)) / vs - F.lit(0.5)) - 1).cast("bigint")
    inside = spans.where(ilo <= ihi).select("polygon", "j", F.explode(F.sequence(ilo, ihi)).alias("i"))
    # centres that sit exactly on a horizontal edge are not strictly inside
    flat = edges.where("y1 = y2").withColumn("j", ((F.col("y1") - F.lit(grid.ymin)) / vs - F.lit(0.5)))
    flat = flat.where((F.col("j") == F.floor("j")) & (F.col("j") >= 0)).withColumn("j", F.col("j").cast("bigint"))
    fa = F.ceil((F.least("x1", "x2") - F.lit(grid.xmin)) / vs - F.lit(0.5)).cast("bigint")
    fb = F.floor((F.greatest("x1", "x2") - F.lit(grid.xmin)) / vs - F.lit(0.5)).cast("bigint")
    edge_on = flat.where(fa <= fb).select("polygon", "j", F.explode(F.sequence(fa, fb)).alias("i"))
    inside = inside.join(edge_on, ["polygon", "i", "j"], "left_anti")
    return inside.groupBy("i", "j").agg(F.max("polygon").alias("polygon"))


def states_from_polygons(vertices: DataFrame, grid: Grid, prior_reassignment: float = 0.5) -> DataFrame:
    """Bottom-layer states from cell outlines."""
    ids = vertices.select("polygon", F.col("cell_id").alias("cell")).distinct()
    won = rasterize_polygons(vertices, grid).join(ids, "polygon")
    won = won.withColumns({"k": F.lit(0).cast("bigint"), "prior_cell": F.col("cell")})
    return _with_prior(won, F.lit(1.0 - prior_reassignment)).select(*STATE)


def relabel_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """Make labels of separately segmented tiles unique: each tile starts after the largest labels of earlier ones.

    ``pixels`` holds ``row_px, col_px, mask_id``; labels restart at 1 in every tile.
    Only the one row per tile is ordered as a whole.
    """
    at = [F.floor(F.col(c) / F.lit(float(tile))).cast("bigint").alias(n) for c, n in (("row_px", "tr"), ("col_px", "tc"))]
    placed = pixels.select("*", *at)
    tops = placed.groupBy("tr", "tc").agg(F.max("mask_id").alias("top"))
    over = Window.orderBy("tr", "tc").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("tr", "tc", F.coalesce(F.sum("top").over(over), F.lit(0)).alias("offset"))
    return placed.join(tops, ["tr", "tc"]).withColumn("mask_id", F.col("mask_id") + F.col("offset")).drop("tr", "tc", "offset")


# -- expansion and bubbles ---------------------------------------------------
def _gather(states: DataFrame, grid: Grid, offsets: list[Offset], keep: Column) -> DataFrame:
    """Per voxel: its own state plus the cells that neighbours in ``keep`` offer it."""
    sent = neighbour_messages(states, grid, [(0, 0, 0), *offsets])
    own = (F.col("di") == 0) & (F.col("dj") == 0) & (F.col("dk") == 0)
    offer = F.when(~own & F.col("cell").isNotNull() & keep, F.col("cell"))
    return sent.groupBy("tu", "tv", *VOXEL).agg(
        F.max(own).alias("exists"),
        F.max(F.when(own, F.col("cell"))).alias("own"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in PRIOR],
        F.min(offer).alias("lo"), F.max(offer).alias("hi"), F.count(offer).alias("offers"),
        F.min(F.when(offer.isNotNull(), F.struct(F.xxhash64(*VOXEL, "di", "dj", "dk"), F.col("cell")))).alias("lot"),
    )


def _same_quad(grid: Grid) -> Column:
    q = grid.quad
    return (tile_of(F.col("i"), q) == tile_of(F.col("i") - F.col("di"), q)) & (
        tile_of(F.col("j"), q) == tile_of(F.col("j") - F.col("dj"), q)
    )


def _expand(
    states: DataFrame, grid: Grid, offsets: list[Offset], keep: Column, lottery: bool, frozen: DataFrame | None
) -> DataFrame:
    if frozen is not None:
        held = frozen.select("cell", F.lit(True).alias("held"))
        keyed_states = states.withColumn("_c", no_match(F.col("cell"), *VOXEL))
        states = keyed_states.join(held.withColumnRenamed("cell", "_c"), "_c", "left").select(*STATE, F.coalesce("held", F.lit(False)).alias("held"))
    else:
        states = states.select(*STATE, F.lit(False).alias("held"))
    got = _gather(states, grid, offsets, keep)
    offered = F.col("lot.cell") if lottery else F.col("lo")
    return got.withColumn("cell", F.coalesce("own", offered)).where("exists OR cell IS NOT NULL").select(*STATE)


def expand_cells(
    states: DataFrame, grid: Grid, rounds: int = 1, lottery: bool = False, frozen: DataFrame | None = None
) -> DataFrame:
    """Grow cells into background 6-neighbours of the same quad, ``rounds`` times.

    Rival claims go to the lowest cell, or with ``lottery`` to a hashed draw.
    Cells listed in ``frozen`` do not grow.
    """
    for _ in range(rounds):
        states = _expand(states, grid, VON_NEUMANN, _same_quad(grid) & ~F.col("held"), lottery, frozen)
    return states


def expand_vertically(
    states: DataFrame, grid: Grid, lottery: bool = False, frozen: DataFrame | None = None
) -> DataFrame:
    """Grow cells up and down until every layer can be reached; with ``frozen``, only those cells."""
    for _ in range(grid.layers - 1):
        keep = F.lit(True) if frozen is None else F.col("held")
        states = _expand(states, grid, VERTICAL, keep, lottery, frozen)
    return states


def pop_bubbles(states: DataFrame, grid: Grid) -> DataFrame:
    """Fill background voxels whose four in-layer neighbours are one and the same cell."""
    got = _gather(states, grid, VON_NEUMANN_XY, F.lit(True))
    fill = F.when((F.col("offers") == 4) & (F.col("lo") == F.col("hi")), F.col("lo"))
    return got.withColumn("cell", F.coalesce("own", fill)).where("exists OR cell IS NOT NULL").select(*STATE)


def mismatch_edges(states: DataFrame, grid: Grid) -> DataFrame:
    """Undirected 6-neighbour voxel pairs in different states, at least one of them a cell.

    Every occupied voxel reports to its six pairs (named by their lower
    voxel); a pair seen once borders background, a pair seen twice is an edge
    if the cells differ. The reports are made after the tile shuffle, in the
    tile of the lower voxel: one shuffle of the voxels, no self join.
    """
    occupied = by_tile(states.where(F.col("cell").isNotNull()).select(*VOXEL, "cell"), grid)
    forward = [d for d in VON_NEUMANN if sum(d) > 0]
    sides = F.array(*[
        F.struct(*[F.lit(c).alias(f"e{a}") for a, c in zip("ijk", d, strict=True)], F.lit(s).alias("second"))
        for d in forward for s in (False, True)
    ])
    rows = occupied.select("*", F.explode(sides).alias("e"))
    back = F.when(F.col("e.second"), F.lit(1)).otherwise(F.lit(0))
    rows = rows.select(
        *[(F.col(c) - back * F.col(f"e.e{c}")).alias(f"a_{c}") for c in VOXEL],
        *[(F.col(c) + (1 - back) * F.col(f"e.e{c}")).alias(f"b_{c}") for c in VOXEL],
        F.col("e.second").alias("second"), "cell", "tu", "tv",
    ).where(f"a_i >= 0 AND a_j >= 0 AND a_k >= 0 AND b_k < {grid.layers}")
    rows = rows.where((tile_of(F.col("a_i"), grid.tile) == F.col("tu")) & (tile_of(F.col("a_j"), grid.tile) == F.col("tv")))
    pair = [f"{s}_{c}" for s in "ab" for c in VOXEL]
    return (
        rows.groupBy("tu", "tv", *pair)
        .agg(F.max(F.when(~F.col("second"), F.col("cell"))).alias("cell_a"), F.max(F.when(F.col("second"), F.col("cell"))).alias("cell_b"))
        .where(~F.col("cell_a").eqNullSafe(F.col("cell_b")))
        .drop("tu", "tv")
    )


def upsample(states: DataFrame, scale: int) -> DataFrame:
    """Replace every voxel by scale x scale finer ones with the same state."""
    sub = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(scale) for b in range(scale)])
    rest = [c for c in states.columns if c not in VOXEL]
    return states.select("*", F.explode(sub).alias("s")).select(
        (F.col("i") * scale + F.col("s.a")).alias("i"), (F.col("j") * scale + F.col("s.b")).alias("j"), "k", *rest
    )
