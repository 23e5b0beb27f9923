"""Tables and files in and out."""
