"""Commands over exact states, simple updates, sampling lattices and neural states: one a line, `#` comments, `\\` joins lines, arguments by name or place."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from ..operators import conversion, neural
from ..operators.sampling import SamplingLattice
from ..operators.simple_update import SimpleUpdate
from ..sources.text import read_tensor, write_tensor
from . import models, plugins


def lines(text: str) -> Iterator[str]:
    held = ""
    for line in text.splitlines():
        line = held + line.split("#")[0].rstrip()
        if line.endswith("\\"):
            held = line[:-1] + " "
            continue
        held = ""
        if line.strip():
            yield line.strip()


def literal(word: str) -> Any:
    try:
        return ast.literal_eval(word)
    except (ValueError, SyntaxError):
        return word


class Shell:
    def __init__(self, spark: SparkSession):
        self.spark, self.seed_value = spark, 0
        self.ex: Any = None
        self.ex_state: Any = None
        self.su: Any = None

    def run(self, script: str) -> list[Any]:
        """The results of a script's commands; `exit` ends it."""
        out = []
        for line in lines(script):
            name, *words = line.split()
            if name in ("exit", "quit"):
                break
            args = [literal(w) for w in words if "=" not in w]
            kwargs = {k: literal(v) for k, v in (w.split("=", 1) for w in words if "=" in w)}
            command = getattr(self, f"do_{name}", None)
            if command is None:
                raise ValueError(f"no command {name}")
            out.append(command(*args, **kwargs))
        return out

    def do_seed(self, value: int) -> None:
        self.seed_value = value

    def do_numpy_hamiltonian(self, name: str, *args: Any, **kwargs: Any) -> Any:
        return models.find(name)(*args, **kwargs).matrix()

    def do_ex_create(self, name: str, *args: Any, **kwargs: Any) -> None:
        self.ex_state, self.ex = models.find(name)(*args, **kwargs), None

    def do_ex_update(self, steps: int) -> float:
        energy, self.ex = self.ex_state.ground_state(self.spark, steps, self.seed_value)
        return energy

    def do_ex_energy(self) -> float:
        from ..operators import exact

        return exact.inner(self.ex, self.ex_state.apply(self.spark, self.ex)) / exact.inner(self.ex, self.ex) / self.ex_state.site_number

    def do_ex_dump(self, path: str) -> None:
        write_tensor(self.ex, path)

    def do_ex_load(self, path: str) -> None:
        self.ex = read_tensor(self.spark, path)

    def do_su_create(self, name: str, *args: Any, D: int = 2, **kwargs: Any) -> None:
        self.su = SimpleUpdate.create(self.spark, models.find(name)(*args, **kwargs), D, self.seed_value)

    def do_su_update(self, steps: int, delta: float, cut: int) -> None:
        self.su.update(steps, delta, cut)

    def do_su_energy(self) -> float:
        return self.su.energy(self.spark)

    def do_su_dump(self, path: str) -> None:
        self.su.sites.write.mode("overwrite").parquet(path)

    def do_su_load(self, path: str) -> None:
        self.su.sites = self.spark.read.parquet(path)

    def do_su_to_ex(self) -> None:
        self.ex_state, self.ex = self.su.state, self.su.to_exact(self.spark)

    def do_su_to_gm(self, cut: int = 16) -> None:
        self.gm = conversion.sampling_from_simple(self.su, cut)

    def do_gm_create(self, name: str, *args: Any, D: int = 2, cut: int = 16, **kwargs: Any) -> None:
        self.gm = SamplingLattice.create(models.find(name)(*args, **kwargs), D, cut, self.seed_value)

    def do_gm_conf_create(self, name: str) -> None:
        self.begin = plugins.beginnings.find(name)

    def do_gm_run(self, samples: int, steps: int, rate: float, sampling: str = "sweep", chains: int = 4, restrict: str | None = None, **options: Any) -> list[tuple[float, float]]:
        sites = dict.fromkeys(self.gm.tensors, 0)
        begin = getattr(self, "begin", None)
        start = (lambda _: begin(sites)) if begin else None
        check = plugins.restrictions.find(restrict) if restrict else None
        return list(self.gm.descend(self.spark, steps, rate, sampling, chains, samples, self.seed_value, start=start, restrict=check, **options))

    def do_gm_expand(self, new: float, noise: float = 0.01) -> None:
        conversion.expand_dimension(self.gm, new, noise, self.seed_value)

    def do_gm_to_ex(self) -> None:
        self.ex_state, self.ex = self.gm.state, conversion.exact_from_sampling(self.spark, self.gm)

    def do_gm_to_su(self) -> None:
        self.su = conversion.simple_from_sampling(self.spark, self.gm)

    def do_gm_hamiltonian(self, name: str, *args: Any, **kwargs: Any) -> None:
        self.gm.state.terms = models.find(name)(*args, **kwargs).terms

    def do_gm_dump(self, path: str) -> None:
        conversion.simple_from_sampling(self.spark, self.gm).sites.write.mode("overwrite").parquet(path)

    def do_gm_load(self, path: str) -> None:
        self.gm = conversion.sampling_from_simple(SimpleUpdate(self.gm.state, self.spark.read.parquet(path)), self.gm.cut)

    def do_nn_create(self, name: str, *args: Any, **kwargs: Any) -> None:
        self.nn_state, self.nn_begin = models.find(name)(*args, **kwargs), None

    def do_nn_network_create(self, name: str, **options: Any) -> None:
        self.nn = neural.NeuralState(self.nn_state, models.network(name)(self.nn_state, **{"seed": self.seed_value} | options))

    def do_nn_conf_create(self, name: str) -> None:
        sites = plugins.beginnings.find(name)(dict.fromkeys(self.nn_state.sites(), 0))
        self.nn_begin = [sites[p[:2]] for p in self.nn_state.points]

    def do_nn_run(self, samples: int, steps: int, rate: float, sampling: str = "sweep", chains: int = 4, **options: Any) -> list[tuple[float, float]]:
        begin = self.nn_begin
        start = (lambda _: begin) if begin else None
        return list(self.nn.descend(self.spark, steps, rate, sampling, chains, samples, self.seed_value, start=start, **options))

    def do_nn_network_dump(self, path: str) -> None:
        neural.write_weights(self.spark, self.nn.network, path)

    def do_nn_network_load(self, path: str) -> None:
        neural.read_weights(self.spark, self.nn.network, path)
