"""Tables and jobs built from the operators."""
