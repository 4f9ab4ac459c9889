"""Plan helpers shared by the operators: scratch tables that cut lineage, and connected components."""
