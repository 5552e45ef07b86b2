"""Issue-corpus retrieval and triage as Spark jobs.

Tables of issue-tracker records go in; typed issue tables, neighbour graphs,
ranked search results, viewer projections and write-back plans come out.
Every public function maps DataFrames to DataFrames.
"""
