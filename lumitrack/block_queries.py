"""Registered queries over rasters in blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumitrack.clip_sql import fixed as sf_fixed
from lumitrack.functions.numbers import fixed
from lumitrack.operators import blocks
from lumitrack.plans.shared import kept, shared_folder
from lumitrack.queries import _SAMPLED, ORACLE_SQL, _gt, _image_pairs, query
from lumitrack.surrogates import IMG, raster, table

#: The images have 64 columns, so blocks are small enough here for each to have neighbours.
SIDE = 32


def _blocks(spark, sf_dir):
    """Stored, as what reads them looks at their sizes before it reads pixels."""
    return kept(blocks.blocks_of(raster(spark, sf_dir), side=SIDE), "blocks")


@query(f"""with {IMG}, b as (select image, "row" // {SIDE} block_row, col // {SIDE} block_col, min(value) low, max(value) high, count(*) n, max("row") - min("row") + 1 height, max(col) - min(col) + 1 width from img group by all)
select image, block_row::int block_row, block_col::int block_col, n::bigint n_pixels, {sf_fixed('low')} low, {sf_fixed('high')} high, {sf_fixed('40e0 - 0.02e0 * block_row * ' + str(SIDE))} north, {sf_fixed('100e0 + 0.02e0 * block_col * ' + str(SIDE))} west
from b where 100e0 + 0.02e0 * (block_col * {SIDE} + width) > 100.7e0 and 40e0 - 0.02e0 * (block_row * {SIDE} + height) < 39.3e0""")
def stored_blocks_in_extent(spark, sf_dir):
    """Blocks written with their places on the ground, and those of a box read again."""
    b = _blocks(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    blocks.write_blocks(blocks.placed(b, spark.range(8).select(F.col("id").cast("int").alias("image"), F.array(*_gt()).alias("gt"))), path)
    found = blocks.in_extent(blocks.read_blocks(spark, path), west=100.7, north=39.3)
    there = F.size(F.filter("value", lambda v: v.isNotNull() & ~F.isnan(v)))
    return found.select("image", "block_row", "block_col", there.cast("long").alias("n_pixels"), *(fixed(F.col(c)).alias(n) for c, n in (("value_low", "low"), ("value_high", "high"), ("north", "north"), ("west", "west"))))


@query(f"with {_SAMPLED} select a.event_id, {sf_fixed('v')} sampled from asked a left join samp using (event_id)")
def block_sample(spark, sf_dir):
    """Values between pixels, read from blocks."""
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", (F.col("event_id") % 8).cast("int").alias("image"), (F.col("value") / 5).alias("x"), (F.col("user_id") % 70 + 0.25).alias("y"))
    return blocks.sampled(asked, _blocks(spark, sf_dir), ["value"], ["event_id"], SIDE).select("event_id", fixed(F.col("sampled_value")).alias("sampled"))


@query(ORACLE_SQL["resampled_cubic"])
def block_resample(spark, sf_dir):
    """Images on other grids, from blocks to blocks."""
    b = _blocks(spark, sf_dir)
    gt = F.array(*(F.lit(v) for v in (100.1, 0.03, 0.0, 39.9, 0.0, -0.025)))
    sizes = blocks.sizes_of(b).withColumnsRenamed({"width": "source_width", "height": "source_height"})
    grids = sizes.withColumns({"width": F.lit(50), "height": F.floor(F.col("source_height") * 2 / 3).cast("int") + 5, "gt": gt, "source_gt": F.array(*_gt())})
    found = blocks.pixels_of(blocks.resampled(b, grids, "cubic", side=SIDE))
    return found.select("image", "row", "col", fixed(F.col("value"), 4).alias("value"))


def _window_sums(names: list[str], source: str) -> str:
    """SQL of sums over 7 x 7 pixels that begin at each pixel which has as many."""
    over = lambda c, by, along: f"sum({c}) over (partition by image, {by} order by {along} rows between current row and 6 following)"
    across = ", ".join(f"{over(n, 'r', 'c')} {n}" for n in names)
    down = ", ".join(f"{over(n, 'c', 'r')} {n}" for n in names)
    return f"across as (select image, r, c, w, h, {across} from {source}), sums as (select * from (select image, r, c, w, h, {down} from across) where r <= h - 7 and c <= w - 7)"


LIKENESS_SQL = f"""with {IMG}, p as (select image, "row" r, col c, value a, value * 0.9e0 + 5e0 b from img),
dark as (select image, greatest(3, floor(quantile_cont(a, 0.15))) d from p group by 1),
box as (select image, avg((a > d)::int) >= 0.05 enough, min(r) filter (a > d) r0, max(r) filter (a > d) r1, min(c) filter (a > d) c0, max(c) filter (a > d) c1, max(r) rm, max(c) cm from p join dark using (image) group by 1),
cut as (select image, r - case when enough then r0 else 0 end r, c - case when enough then c0 else 0 end c, case when enough then c1 - c0 else cm end + 1 w, case when enough then r1 - r0 else rm end + 1 h, a, b, a * a aa, b * b bb, a * b ab
  from p join box using (image) where not enough or (r between r0 and r1 and c between c0 and c1)),
{_window_sums(['a', 'b', 'aa', 'bb', 'ab'], 'cut')},
m as (select image, a / 49e0 ma, b / 49e0 mb, 49e0 / 48e0 * (aa / 49e0 - a / 49e0 * a / 49e0) va, 49e0 / 48e0 * (bb / 49e0 - b / 49e0 * b / 49e0) vb, 49e0 / 48e0 * (ab / 49e0 - a / 49e0 * b / 49e0) cab from sums)
select i.image, {sf_fixed("coalesce(avg((2 * ma * mb + pow(0.01e0 * 255, 2)) * (2 * cab + pow(0.03e0 * 255, 2)) / ((ma * ma + mb * mb + pow(0.01e0 * 255, 2)) * (va + vb + pow(0.03e0 * 255, 2)))), 'nan'::double)", 5)} likeness from (select distinct image from img) i left join m using (image) group by 1"""
#: The same by tiles of pixels.
ORACLE_SQL["tile_likeness"] = LIKENESS_SQL


@query(LIKENESS_SQL)
def block_likeness(spark, sf_dir):
    b = kept(blocks.blocks_of(_image_pairs(spark, sf_dir), ["a", "b"], SIDE), "blocks")
    return blocks.likeness(b, side=SIDE).select("image", fixed(F.col("likeness"), 5).alias("likeness"))


@query()
def block_flow(spark, sf_dir):
    """Flow between images and themselves moved one pixel to the right, from blocks to blocks."""
    r = raster(spark, sf_dir)
    # a pixel's left neighbour is the pixel that comes to lie on it, the first column stays
    moved = r.select("image", "row", F.explode(F.when(F.col("col") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("col") + 1))).alias("col"), F.col("value").alias("b"))
    both = r.withColumnRenamed("value", "a").join(moved, ["image", "row", "col"])
    side = 8 * SIDE  # a block sees 304 rows and columns on each side
    f = blocks.pixels_of(blocks.flow(blocks.blocks_of(both, ["a", "b"], side), side=side), ["dx", "dy"])
    return f.select("image", "row", "col", fixed(F.col("dx"), 4).alias("dx"), fixed(F.col("dy"), 4).alias("dy"))
