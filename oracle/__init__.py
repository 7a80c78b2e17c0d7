"""Each report once more, as DuckDB SQL over the test tables, to check results against."""

from oracle import anomaly, kpi, model, quality

ORACLES = {**quality.ORACLES, **anomaly.ORACLES, **model.ORACLES, **kpi.ORACLES}
