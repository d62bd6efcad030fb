"""Column builders: every one is a Catalyst expression that stays in whole-stage codegen."""
