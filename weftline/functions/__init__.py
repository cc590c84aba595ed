"""Part of the procedure-workflow analytics engine."""
