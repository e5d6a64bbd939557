"""Table-to-table operators built from DataFrame/SQL primitives."""
