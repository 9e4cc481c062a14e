import math

import pytest
from pyspark.sql import functions as F

from orbitlake.sources import city, meshes, nmea, rinex, sinks, tables


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_gnss_and_truth_tables(spark, tmp_path):
    g = put(tmp_path, "g.csv", "GPS_time, PRN, pseudorange, CN0, extra\n1.0, G01, 2.1e7, 40, 7\n1.0, G02, bad, , 8\n2.0, E03, 2.2e7, 33, x\n")
    rows = tables.gnss_csv(spark, g).collect()
    assert [(r.time, r.prn, r.pseudorange, r.cn0, r.carrier, r.extra) for r in rows] == [(1.0, "G01", 2.1e7, 40.0, None, 7.0), (1.0, "G02", None, None, None, 8.0), (2.0, "E03", 2.2e7, 33.0, None, None)]
    x = put(tmp_path, "x.csv", "GPS TOW (s), GPS Week, Latitude (deg), Longitude (deg), Ellipsoid Height (m), ECEF X (m), ECEF Y (m), ECEF Z (m)\n5.0, 1, 0, 0, 0, 10, 20, 30\n")
    assert tuple(tables.truth_csv(spark, x).first()) == (5.0, 10.0, 20.0, 30.0)
    l = put(tmp_path, "l.csv", "time,lat,lon,alt\n5,0,90,100\n")
    r = tables.truth_csv(spark, l).first()
    assert r.y == pytest.approx(6378237.0) and abs(r.x) < 1e-3
    with pytest.raises(ValueError):
        tables.truth_csv(spark, put(tmp_path, "n.csv", "time,a\n1,2\n"))


def test_other_names_of_gnss_columns(spark, tmp_path):
    g = put(tmp_path, "o.csv", "GPSTime,SatID,C1,CNR,D2,CarrierPhase\n3.5,G07,2.3e7,41,-100.5,1.2e8\n")
    assert tuple(tables.gnss_csv(spark, g).first()) == (3.5, "G07", 2.3e7, 1.2e8, 41.0, -100.5)
    for i, head in enumerate(("PRN,C1", "GPSTime,C1", "GPSTime,SV,L1")):
        with pytest.raises(ValueError, match="no column of"):
            tables.gnss_csv(spark, put(tmp_path, f"m{i}.csv", f"{head}\n1,2,3\n"))
    assert len(tables.RAW_FIELDS) == 36 and tables.RAW_FIELDS[0] == "utcTimeMillis" and tables.RAW_FIELDS[-1] == "ChipsetElapsedRealtimeNanos"


def test_inertial_tables(spark, tmp_path):
    p = put(tmp_path, "p.csv", " GPS TOW (s), GPS Week, Acc X (m/s^2), Acc Y (m/s^2), Acc Z (m/s^2), Ang Rate X (deg/s), Ang Rate Y (deg/s), Ang Rate Z (deg/s)\n1.5, 2, 1, 2, 3, 180, 0, 90\n")
    r = tables.imu_csv(spark, p).first()
    assert (r.tow, r.az) == (1.5, 3.0) and r.gx == pytest.approx(math.pi)
    u = put(tmp_path, "u.csv", "h,h,h,h,h,h,h,h,h\n1,0,1,2,3,4,5,6,7.5\n2,0,1\n3,0,1,2,3,4,5,6,\n")
    assert [(r.tow, r.gz, r.wheel) for r in tables.imu_positional(spark, u).collect()] == [(1.0, 6.0, 7.5), (3.0, 6.0, None)]


def test_raw_log_lines(spark, tmp_path):
    line = lambda t, svid, code: "Raw," + ",".join({"utcTimeMillis": str(t), "FullBiasNanos": "-1234567890123456789", "Svid": str(svid), "CodeType": code}.get(c, "1.5") for c in tables.RAW_FIELDS)
    text = "# header\nFix,1\n" + "\n".join([line(1, 3, "C"), line(1, 4, "C"), line(1, 3, "C"), line(1, 4, "C"), "Raw,2,7"]) + "\n"
    p = put(tmp_path, "log.txt", text)
    rows = tables.raw_log(spark, p).collect()
    assert len(rows) == 5 and rows[0].FullBiasNanos == -1234567890123456789 and rows[0].CodeType == "C" and rows[4].Svid is None and rows[4].utcTimeMillis == 2
    assert tables.raw_log(spark, p, half_of_repeats=True).count() == 2


OBS3 = """     3.04           OBSERVATION DATA    M                   RINEX VERSION / TYPE
G    3 C1C L1C S1C                                          SYS / # / OBS TYPES
E    2 C1X L1X                                              SYS / # / OBS TYPES
                                                            END OF HEADER
> 2021 03 04 05 06  7.5000000  0  2
G01  21000000.123 7 110000000.456 7        45.000
E11  23000000.500                
> 2021 03 04 05 06  8.5000000  0  1
G 2  22000000.000                        bad
> 2021 03 04 05 06  9.5000000  4  1
COMMENT
"""


def test_observations_of_version_three(spark, tmp_path):
    obs = rinex.observations(spark, put(tmp_path, "a.obs", OBS3))
    got = {(str(r.time), r.satellite, r.code): r.value for r in obs.collect()}
    t0, t1 = "2021-03-04 05:06:07.500000", "2021-03-04 05:06:08.500000"
    assert got == {(t0, "G01", "C1C"): 21000000.123, (t0, "G01", "L1C"): 110000000.456, (t0, "G01", "S1C"): 45.0, (t0, "E11", "C1X"): 23000000.5, (t0, "E11", "L1X"): 0.0, (t1, "G02", "C1C"): 22000000.0, (t1, "G02", "L1C"): 0.0, (t1, "G02", "S1C"): 0.0}
    lists = rinex.pseudorange_lists(obs, "C1C").orderBy("time").collect()
    assert [r.satellites for r in lists] == [["G01"], ["G02"]]


def test_observations_of_version_two(spark, tmp_path):
    names = "".join(f"G{i:2d}" for i in range(1, 13))
    text = "     2.11           OBSERVATION DATA    G (GPS)".ljust(60) + "RINEX VERSION / TYPE\n" + "     2    C1    L1".ljust(60) + "# / TYPES OF OBSERV\n" + " " * 60 + "END OF HEADER\n"
    text += " 21  3  4  5  6  7.5000000  0 13" + names + "\n" + " " * 32 + " 13\n" + "".join(f"{2e7 + i:14.3f}  {i:14.3f}\n" for i in range(1, 14))
    got = {(r.satellite, r.code): r.value for r in rinex.observations_v2(spark, put(tmp_path, "b.obs", text)).collect()}
    assert len(got) == 26 and got["G13", "C1"] == 2e7 + 13 and got["G01", "L1"] == 1.0


def test_navigation_records(spark, tmp_path):
    n = lambda *v: "".join(f"{x:19.12E}".replace("E", "D") for x in v)
    head = "GPSA   1.0D-08  2.0D-08 -3.0D-08 -4.0D-08".ljust(60) + "IONOSPHERIC CORR\n" + "GPSB   1.0D+05  2.0D+05 -3.0D+05 -4.0D+05".ljust(60) + "IONOSPHERIC CORR\n" + " " * 60 + "END OF HEADER\n"
    kepler = "G05 2021 03 04 02 00 00" + n(1e-4, 2e-12, 0) + "\n" + "".join("    " + n(*[10 * i + j for j in range(4)]) + "\n" for i in range(7))
    glonass = "R03 2021 03 04 02 15 00" + n(5e-5, 6e-12, 0) + "\n" + "".join("    " + n(*[10 * i + j for j in range(4)]) + "\n" for i in range(3))
    p = put(tmp_path, "c.nav", head + kepler + glonass)
    got = {r.system: r for r in rinex.navigation(spark, p).collect()}
    assert (got["G"].prn, got["G"].sqrt_a, got["G"].toe, got["G"].omega_dot, got["G"].tgd) == (5, 13.0, 20.0, 33.0, 52.0)
    assert (got["R"].px, got["R"].vy, got["R"].az, got["R"].sqrt_a, got["R"].toe) == (0.0, 11000.0, 22000.0, None, got["R"].toc)
    r = rinex.ionosphere_parameters(spark, p).first()
    assert r.alpha == [1e-8, 2e-8, -3e-8, -4e-8] and r.beta[3] == -4e5


def test_meshes_and_sight(spark, tmp_path):
    obj = put(tmp_path, "m.obj", "# a square\nv 0 -1 -1\nv 0 1 -1\nv 0 1 1\nv 0 -1 1\nf 1/1/1 2/2/2 3 4\n")
    assert meshes.obj_triangles(spark, obj).count() == 2
    mesh = meshes.box(spark, (0.0, 0.0, 0.0), 2.0, 4.0, 6.0)
    assert mesh.count() == 12
    rays = spark.createDataFrame([(-9.0, 0.0, 0.0, 9.0, 0.0, 0.0), (-9.0, 0.0, 0.0, -3.0, 0.0, 0.0), (-9.0, 2.5, 0.0, 9.0, 2.5, 0.0), (-9.0, 0.5, 2.9, 9.0, 0.5, 2.9)], "rx double, ry double, rz double, sx double, sy double, sz double")
    assert [r.los for r in meshes.line_of_sight(rays, mesh).collect()] == [False, True, True, False]


def test_sentences_come_back(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-05-06 07:08:09.25' t, 48.1173 lat, -11.516667 lon, 545.4 alt, 4 q, 9 n, 0.9 h")
    c = F.col
    sinks.write_nmea(df, f"{tmp_path}/out", [sinks.gga(c("t"), c("lat"), c("lon"), c("alt"), c("q"), c("n"), c("h")), sinks.rmc(c("t"), c("lat"), c("lon"), F.lit(22.4), F.lit(84.4))])
    got = nmea.read(spark, f"{tmp_path}/out").orderBy("kind").collect()
    assert [r.kind for r in got] == ["GGA", "RMC"] and got[0].utc == "070809.250" and got[0].satellites == 9
    assert all(r.lat == pytest.approx(48.1173, abs=1e-7) and r.lon == pytest.approx(-11.516667, abs=1e-7) for r in got)


def test_other_sinks(spark, tmp_path):
    a, b = spark.sql("select 1 x, 'p' y"), spark.sql("select 2 x, 3.5D z")
    sinks.write_csv_union([a, b], f"{tmp_path}/u")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/u").select("x", "y", "z").collect())) == [("1", "p", None), ("2", None, "3.5")]
    cell = sinks.geojson_cells(spark.sql("select 139D lon, 35D lat, 1.5D pdop"), "lon", "lat", 0.5, "pdop").first()[0]
    assert '"type":"Feature"' in cell and "[138.5,34.5]" in cell and '"pdop":1.5' in cell
    sinks.export_run(a, b, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e/positions").count() == 1 and spark.read.text(f"{tmp_path}/e/metrics").count() == 1
    put(tmp_path, "tokyo_run1_x.csv", "v\n1\n")
    put(tmp_path, "nagoya_run2_x.csv", "v\n2\n")
    got = tables.result_csvs(spark, f"{tmp_path}/*_x.csv", r"/([a-z]+)_(run\d)_x", ["city", "run"]).orderBy("v").collect()
    assert [(r.v, r.city, r.run) for r in got] == [(1, "tokyo", "run1"), (2, "nagoya", "run2")]


def ring(points, how="list"):
    flat = " ".join(f"{v}" for p in points for v in p)
    inner = f"<gml:posList srsDimension='3'>\n  {flat}\n</gml:posList>" if how == "list" else "".join(f"<gml:pos>{p[0]} {p[1]} {p[2]}</gml:pos>" for p in points)
    return f"<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing>{inner}</gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>"


def test_city_models_by_records(spark, tmp_path):
    square = [(0, 0, 1), (0, 4, 1), (4, 4, 1), (4, 0, 1), (0, 0, 1)]
    wall = [(0, 0, 1), (4, 0, 1), (4, 0, 9)]
    text = f"""<?xml version="1.0"?><core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g"><!-- a Building> in a comment -->
<core:cityObjectMember><bldg:Building gml:id="one"><bldg:measuredHeight>8</bldg:measuredHeight><bldg:lod1Solid><gml:Solid>{ring(square)}{ring(wall, "pos")}</gml:Solid></bldg:lod1Solid></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building><bldg:lod1Solid/><bldg:lod2MultiSurface>{ring(wall)}</bldg:lod2MultiSurface></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><brid:Bridge gml:id="deck">{ring(square, "pos")}</brid:Bridge></core:cityObjectMember></core:CityModel>"""
    bare = '<CityModel><b:Building b:x="1" id="three"></b:Building></CityModel>'
    put(tmp_path, "a.gml", text), put(tmp_path, "b.gml", bare)
    got = sorted(((r.id, r.kind, r.lod, [[tuple(p) for p in q] for q in r.polygons]) for r in city.city_features(spark, str(tmp_path)).collect()), key=str)
    as_points = lambda q: [tuple(map(float, p)) for p in q]
    assert got == sorted([("one", "bldg", 1, [as_points(square), as_points(wall)]), (None, "bldg", 2, [as_points(wall)]), ("three", "bldg", 0, [])], key=str)
    bridges = city.city_features(spark, str(tmp_path), "brid")
    assert [(r.id, r.lod) for r in bridges.collect()] == [("deck", 0)]
    tri = city.city_triangles(city.city_features(spark, str(tmp_path))).where("id = 'one'").orderBy("polygon", "x1", "y1").collect()
    assert [(t.polygon, t.x1, t.y1, t.x2, t.y2) for t in tri] == [(0, 0.0, 4.0, 4.0, 4.0), (0, 4.0, 4.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 0.0)]
    rays = spark.createDataFrame([(2.0, 1.0, 0.0, 2.0, 1.0, 5.0), (9.0, 9.0, 0.0, 9.0, 9.0, 5.0)], "rx double, ry double, rz double, sx double, sy double, sz double")
    assert sorted(r.los for r in meshes.line_of_sight(rays, city.city_triangles(city.city_features(spark, str(tmp_path)))).collect()) == [False, True]
    with pytest.raises(ValueError):
        city.city_features(spark, str(tmp_path), "tunnel")
    put(tmp_path, "c.gml", f'<x:Building id="odd">{ring([(1, 2, 3)]).replace("1 2 3", "1 2")}</x:Building>')
    with pytest.raises(Exception, match="coordinates is not of points"):
        city.city_features(spark, f"{tmp_path}/c.gml").collect()


def test_city_models_are_split_anywhere(spark, tmp_path):
    wall = [(0, 0, 1), (4, 0, 1), (4, 0, 9)]
    body = "".join(f'<m><bldg:Building gml:id="b{i}"><bldg:lod2Solid>{ring(wall)}</bldg:lod2Solid></bldg:Building></m>\n' for i in range(400))
    put(tmp_path, "big.gml", f"<core:CityModel>{body}</core:CityModel>")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        df = city.city_features(spark, f"{tmp_path}/big.gml")
        assert df.rdd.getNumPartitions() > 10
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(r.id for r in rows) == sorted(f"b{i}" for i in range(400)) and all(r.lod == 2 and len(r.polygons) == 1 for r in rows)


def test_city_points_in_degrees(spark, tmp_path):
    put(tmp_path, "g.gml", f'<bldg:Building gml:id="g">{ring([(0, 90, 0), (0, 0, 0), (90, 0, 0)])}</bldg:Building>')
    t = city.city_triangles(city.city_features(spark, str(tmp_path)), geographic=True, origin=(1.0, 0.0, 0.0)).first()
    assert (t.y0, t.x1) == pytest.approx((6378137.0, 6378136.0)) and t.z2 == pytest.approx(6356752.314, abs=1e-2)
