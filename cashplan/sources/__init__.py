"""Reading and writing: named tables and bank export files."""
