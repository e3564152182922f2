"""python -m loomgraph index CONFIG OUT | ask GRAPH_FOLDER QUESTION"""

import sys

from loomgraph.operators.graph import PropertyGraph
from loomgraph.plans import nlq, pipeline
from loomgraph.session import get_spark
from loomgraph.sources.files import read_config


def main(args: list[str]) -> int:
    if args[:1] == ["index"] and len(args) == 3:
        state = pipeline.run(get_spark(), read_config(args[1]), out=args[2])
        state.graph.edges.groupBy("type").count().orderBy("type").show(100, False)
        return 0
    if args[:1] == ["ask"] and len(args) == 3:
        spark = get_spark()
        g = PropertyGraph(spark.read.parquet(f"{args[1]}/nodes"), spark.read.parquet(f"{args[1]}/edges"))
        nlq.ask(g, args[2]).show(50, False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
