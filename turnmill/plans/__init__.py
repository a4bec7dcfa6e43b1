"""Jobs made of several operators: what a user runs end to end."""
