"""Tables: where they come from, what is known about them and where they go."""
