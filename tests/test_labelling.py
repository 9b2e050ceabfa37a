"""The whole way from scan files to labelled scan files."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import labels as L
from pointloom.operators import stages
from pointloom.plans import labelling
from pointloom.sources import files


def test_folder_of_tiles(spark, tmp_path):
    rng = random.Random(1)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir(), target.mkdir()
    rows = []
    for tile, (x0, y0) in {"2386_9702": (119300, 485100), "2387_9702": (119350, 485100)}.items():
        for i in range(400):
            z = rng.choice([0.05, 2.0, 7.0])
            rows.append((tile, i, x0 + rng.uniform(0, 50), y0 + rng.uniform(0, 50), z, 0))
    points = spark.createDataFrame(rows, "tilecode string, point_id long, x double, y double, z double, label int")
    files.save_las(points, str(source), "scan_")
    cloud = [(k, 119300 + 2.0 * (k % 51), 485100 + 2.0 * (k // 51), 0.0, 2) for k in range(51 * 26)]
    cloud += [(9000 + 60 * k + j, 119300.0 + k, 485100.0 + j, 6.0, 6) for k in range(50) for j in range(51)]
    elevation = labelling.build_elevation(spark.createDataFrame(cloud, "id long, x double, y double, z double, classification int"), points, 5, ground_radius=4.0, building_radius=4.0)
    assert elevation.count() == 200 and elevation.where("ground = 0").count() == 200
    done = labelling.label_cloud(points, elevation, [stages.Ground(refine=False), stages.BelowRoof()], cell=5)
    assert done.columns == points.columns
    for r in done.collect():
        want = L.GROUND if r.z < 0.2 else L.BUILDING if r.z < 6.2 and r.x < 119351 else None
        if want:
            assert r.label == want or 119345 < r.x < 119356
    make = lambda spark: [stages.Ground(refine=False)]
    stats = {r.label: r.n for r in labelling.label_folder(spark, str(source), str(target), fine(elevation), make, "scan_").collect()}
    assert sum(stats.values()) == 800 and stats[L.GROUND] == sum(r[4] < 0.2 for r in rows)
    with pytest.raises(ValueError):
        labelling.label_folder(spark, str(source), str(source) + "/", elevation, make)


def fine(elevation):
    """The same elevation in cells of 0.1 m."""
    step = F.sequence(F.lit(0), F.lit(49))
    out = elevation.withColumn("a", F.explode(step)).withColumn("b", F.explode(step))
    return out.select("tilecode", (F.col("ix") * 50 + F.col("a")).alias("ix"), (F.col("iy") * 50 + F.col("b")).alias("iy"), "ground", "building")
