import pytest

from tessella.functions import catalog as cat
from tessella.functions import scalars as sc


def packages():
    a = cat.Package("a")
    a.add_field("u", cat.Metadata.of("Cell", "Independent", "WithFluxes", shape=(3,)))
    a.add_field("v", cat.Metadata.of("Cell", "Derived", "Restart"))
    a.add_field("hidden", cat.Metadata.of("Cell", "Private"))
    a.add_sparse_pool("s", cat.Metadata.of("Cell", "Independent"), [1, 4, 9])
    b = cat.Package("b")
    b.add_field("v", cat.Metadata.of("Cell", "Overridable"))
    b.add_field("w", cat.Metadata.of("Cell", "Overridable"))
    return a, b


def test_resolution_and_selection():
    c = cat.resolve(packages())
    assert "a::hidden" in c.select() and "w" in c.select()
    assert c.select(names=["v", "nothing", "u", "v"]) == ["v", "u"]
    assert c.select(names=["s"], sparse_ids=[4, 9]) == ["s_4", "s_9"]
    assert c.select(names=["s_.*"], regex=True) == ["s_1", "s_4", "s_9"]
    assert c.select(flags=cat.FlagCollection.all_of("Cell", "Restart")) == ["v"]
    assert c.select(fluxes="OnlyFlux") == ["bnd_flux::u"]
    assert c.size(["u", "v"]) == 4 and c.index(["u", "v"]) == {"u": (0, 2), "v": (3, 3)}
    assert "Restart" in c.meta("v").flags


def test_flag_algebra():
    any_of, all_of = cat.FlagCollection.any_of, cat.FlagCollection.all_of
    m = cat.Metadata.of("Cell", "Independent", "Advected")
    assert (any_of("Advected") + any_of("Sparse")).matches(m)
    assert (all_of("Cell") * all_of("Advected")).matches(m)
    assert not (all_of("Cell") - any_of("Advected")).matches(m)
    assert cat.FlagCollection().matches(m)


@pytest.mark.parametrize("flags", [("Independent", "Derived"), ("Vector", "Tensor"), ("Cell", "Face"), ("NoSuchFlag",)])
def test_invalid_metadata(flags):
    with pytest.raises(ValueError):
        cat.Metadata.of(*flags)


def test_roles_that_do_not_resolve():
    a, _ = packages()
    twice = cat.Package("twice")
    twice.add_field("v", cat.Metadata.of("Cell"))
    with pytest.raises(ValueError):
        cat.resolve([a, twice])
    needs = cat.Package("needs")
    needs.add_field("absent", cat.Metadata.of("Cell", "Requires"))
    with pytest.raises(ValueError):
        cat.resolve([needs])
    assert a.add_field("u", cat.Metadata.of("Cell")) is False


def test_params():
    p = cat.Package("p")
    p.add_param("cfl", 0.4, "Restart")
    p.add_param("fixed", 1)
    p.update_param("cfl", 0.3)
    assert p.param("cfl") == 0.3
    with pytest.raises(TypeError):
        p.update_param("fixed", 2)
    with pytest.raises(TypeError):
        p.update_param("cfl", "much")
    with pytest.raises(KeyError):
        p.add_param("fixed", 3)


def test_constants_scale_with_units():
    si, cgs = sc.constants(sc.SI), sc.constants(sc.CGS)
    assert cgs["speed_of_light"] == pytest.approx(100 * si["speed_of_light"])
    assert cgs["boltzmann"] == pytest.approx(1e7 * si["boltzmann"])


def test_unpack(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.b.",), ("a",), ("",), ("x.y",)], "s string")
    assert [r[0] for r in df.select(sc.unpack(F.col("s"), ".")).collect()] == [["a", "b"], ["a"], [], ["x", "y"]]
