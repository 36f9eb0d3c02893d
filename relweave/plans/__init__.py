"""From operations to DataFrames: the tree of associations and the planner."""
