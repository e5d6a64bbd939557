"""Column-expression functions (all JVM-side, inside whole-stage codegen)."""
